"""Entity alignment: name rules, similarity, and ancestors read from descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.sequential import name_scores
from weftgraph.functions.text import normal_name

# Single surnames, compound surnames, and the phrases that name an ancestor.
SURNAMES = (
    "王李张刘陈杨赵黄周吴孙朱马胡郭何高林罗郑梁谢宋唐韩冯邓曹彭曾田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦白邹孟熊"
    "秦江尹薛段雷侯龙史陶黎贺顾毛郝龚邵钱覃武戴莫孔向汤"
)
COMPOUND = ("诸葛", "欧阳", "上官", "司马", "南宫", "令狐", "慕容")
DESCENT = (
    ("之后人?", "之后"), ("之女", "之女"), ("(?:与|和|跟)[一-龥]{2,3}之子", "之子"), ("之子", "之子"),
    ("之孙", "之孙"), ("之孙女", "之孙女"), ("的(?:女儿|闺女)", "之女"), ("的(?:儿子|孩儿)", "之子"),
)


def rule_groups(nodes: DataFrame, normal=normal_name) -> DataFrame:
    """Decisions alias -> canonical among names of one label and era that are one name by rule.

    The longest name of a group is canonical, of equally long ones the first.
    """
    named = nodes.withColumn("key", normal(F.col("name")))
    group = named.groupBy("label", F.coalesce("era", F.lit("")).alias("era"), "key").agg(
        F.min_by("name", F.struct((-F.length("name")).alias("l"), "name")).alias("canonical"), F.array_sort(F.collect_set("name")).alias("names"))
    out = group.where(F.size("names") > 1).select("label", "era", "canonical", F.explode("names").alias("alias"))
    return out.where("alias != canonical").select("label", "era", "alias", "canonical")


def _without_one(name: Column) -> Column:
    """All texts that are a name without one of its characters."""
    return F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))


def _meeting(names: DataFrame, least: float) -> DataFrame:
    """label, a, b (a < b) of names of which no pair that is alike is left out.

    Of similar names whose lengths differ by 2 at most, the shorter one, of s characters, has
    `least` of them in common with the longer one, in order. Where that is all of them, the longer
    one without as many characters as it has more is the shorter one. Else they share a run of two
    characters, and one among the 3 * floor((1 - least) * s) + 5 rarest of each: a missing character
    takes away two runs at most, one that is too many one.
    """
    lost = 1 - least + 1e-4  # scores are rounded
    short_to = int(1 / lost)  # up to so many characters, none may be missing
    short_to -= short_to * lost >= 1
    n = F.length("name")
    key = names.where(n <= short_to).select("label", F.col("name").alias("key"), F.col("name").alias("short"))
    one = _without_one(F.col("name"))
    cut = names.where((n >= 2) & (n <= short_to + 2)).withColumn("one", one)
    cut = cut.withColumn("two", F.when(n >= 3, F.flatten(F.transform("one", lambda x: _without_one(x)))).otherwise(F.array().cast("array<string>")))
    cut = cut.select("label", F.col("name").alias("long"), F.explode(F.array_distinct(F.concat("one", "two"))).alias("key"))
    near = key.join(cut, ["label", "key"]).select("label", F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring("name", i, F.lit(2))))
    keyed = names.where(n > short_to).withColumn("g", F.explode(runs))
    counts = keyed.groupBy("label", "g").agg(F.count("*").alias("n"))
    rare = F.row_number().over(Window.partitionBy("label", "name").orderBy("n", "g"))
    keyed = keyed.join(counts, ["label", "g"]).withColumn("r", rare).where(F.col("r") <= 3 * F.floor(F.lit(lost) * n) + 5).select("label", "g", "name")
    x, y = keyed.alias("x"), keyed.alias("y")
    met = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.name") < F.col("y.name")) & (F.abs(F.length("x.name") - F.length("y.name")) <= 2))
    met = met.select(F.col("x.label").alias("label"), F.col("x.name").alias("a"), F.col("y.name").alias("b"))
    return near.unionByName(met).distinct()


def similar_pairs(nodes: DataFrame, least: float = 0.85, sound=None) -> DataFrame:
    """Pairs of names of one label whose lengths differ by 2 at most and that are alike.

    sound is a provider of how a name is spoken; names that only sound alike have to meet by their
    characters too.
    """
    pairs = _meeting(nodes.select("label", "name").distinct(), least)
    scored = pairs.withColumn("score", F.round(name_scores(F.col("a"), F.col("b"), sound), 4)).where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "label", "a", "b")


def ancestors(nodes: DataFrame) -> DataFrame:
    """ancestor, descendant, kind named by descriptions (name, description)."""
    who = f"((?:[{SURNAMES}]|{'|'.join(COMPOUND)})[一-龥]{{1,3}})"
    found = [nodes.select(F.explode(F.regexp_extract_all("description", F.lit(who + p), F.lit(1))).alias("ancestor"), F.col("name").alias("descendant"), F.lit(k).alias("kind")) for p, k in DESCENT]
    return reduce(DataFrame.unionByName, found).distinct()


def known_ancestors(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """found with why a pair cannot become an edge (null: it can)."""
    names = nodes.select("name").distinct()
    a = names.select(F.col("name").alias("ancestor"), F.lit(True).alias("has_a"))
    b = names.select(F.col("name").alias("descendant"), F.lit(True).alias("has_b"))
    out = found.join(a, "ancestor", "left").join(b, "descendant", "left")
    reason = F.when(F.col("ancestor") == F.col("descendant"), "self").when(F.col("has_a").isNull(), "no_ancestor").when(F.col("has_b").isNull(), "no_descendant")
    return out.withColumn("reason", reason).drop("has_a", "has_b")
