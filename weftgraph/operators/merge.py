"""Merging of nodes that are one: properties are absorbed, edges move, and what happened is counted.

Nodes are identified by label and name, so an art and a person of one name stay two. Only the rows
that a decision touches are grouped; all others pass through the anti-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import store
from weftgraph.schema import EDGE, NODE, RELATIONS

UNKNOWN_ERA = "未知"
MENTIONS = "MENTIONS"
KEY = ["type", "src_label", "src", "dst_label", "dst"]
_PART = "\x1f"


def columns(schema: str) -> dict[str, str]:
    """Names and types of a schema's text, of flat columns."""
    return dict(c.strip().split(" ", 1) for c in schema.split(", "))


def completed(rows: DataFrame, schema: str) -> DataFrame:
    """rows with all columns of a schema, nulls where they had none."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns(schema).items()])


def _node(label: str | Column, name: str | Column) -> Column:
    return F.concat_ws(_PART, label, name)


def final_decisions(nodes: DataFrame, edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (label, alias, canonical) followed to their ends, for aliases that exist, with blocked.

    An alias that has edges of a type outside the ontology is blocked: it stays as it is, for a person
    to look at.
    """
    flat = store.flatten_aliases(decisions.select(_node("label", "alias").alias("alias"), _node("label", "canonical").alias("canonical")))
    part = lambda c, k: F.get(F.split(c, _PART), F.lit(k))
    flat = flat.select(part("alias", 0).alias("label"), part("alias", 1).alias("alias"), part("canonical", 1).alias("canonical"))
    flat = flat.join(nodes.select("label", F.col("name").alias("alias")), ["label", "alias"], "left_semi")
    strange = edges.where(~F.col("type").isin(*[r[0] for r in RELATIONS], MENTIONS))
    ends = strange.select(F.col("src_label").alias("label"), F.col("src").alias("alias")).unionByName(strange.select(F.col("dst_label").alias("label"), F.col("dst").alias("alias")))
    return flat.join(ends.distinct().withColumn("blocked", F.lit(True)), ["label", "alias"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def absorbed(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Nodes after moves (label, alias, canonical): the canonical one's values come first.

    Era, first era, location and art type are the first there are, the longest description stays (the
    earlier one of equally long ones), eras, books and aliases grow. A canonical node that did not
    exist is made, with the era 未知.
    """
    rows = completed(nodes, NODE)
    own = moves.select("label", F.col("canonical").alias("name")).distinct()
    gone = rows.join(moves.select("label", F.col("alias").alias("name"), "canonical"), ["label", "name"])
    kept = rows.join(own, ["label", "name"], "left_semi")
    made = completed(own.join(kept.select("label", "name"), ["label", "name"], "left_anti").select("label", "name", F.lit(UNKNOWN_ERA).alias("era"), F.array(F.lit(UNKNOWN_ERA)).alias("eras")), NODE)
    rest = rows.join(moves.select("label", F.col("alias").alias("name")), ["label", "name"], "left_anti").join(own, ["label", "name"], "left_anti")
    none = F.array().cast("array<string>")
    first = kept.unionByName(made).withColumn("canonical", F.col("name")).withColumn("rank", F.lit(0))
    other = gone.withColumn("rank", F.lit(1)).withColumn("first_seen_era", F.coalesce("first_seen_era", "era"))
    other = other.withColumn("eras", F.when(F.col("era").isNotNull(), F.array("era")).otherwise(none)).withColumn("aliases", F.array("name"))
    both = first.unionByName(other).withColumn("ord", F.struct("rank", "name", F.coalesce("era", F.lit(""))))

    def earliest(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)

    def grown(c: str) -> Column:
        held = F.array_sort(F.collect_list(F.struct("ord", F.coalesce(c, none).alias("v"))))
        return F.array_distinct(F.flatten(F.transform(held, lambda x: x["v"]))).alias(c)

    longest = F.min_by("description", F.when(F.length("description") > 0, F.struct((-F.length("description")).alias("l"), "ord"))).alias("description")
    merged = both.groupBy("label", "canonical").agg(*map(earliest, ("era", "first_seen_era", "location", "art_type")), *map(grown, ("eras", "books", "aliases")), longest)
    return rest.unionByName(merged.withColumnRenamed("canonical", "name").select(*rest.columns))


def merge(nodes: DataFrame, edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and a report after decisions (label, alias, canonical).

    The report has label, canonical, merged (aliases that went), created_edges, skipped_edges (the
    canonical node had them, or another alias brought them), dropped_edges (within the group) and
    errors (aliases that are blocked). A moved edge keeps its properties.
    """
    final = final_decisions(nodes, edges, decisions)
    moves = final.where("NOT blocked").drop("blocked")
    rows = completed(edges, EDGE)
    to = lambda end: moves.select(F.col("label").alias(f"{end}_label"), F.col("alias").alias(end), F.col("canonical").alias(f"{end}_to"))
    rows = rows.join(to("src"), ["src_label", "src"], "left").join(to("dst"), ["dst_label", "dst"], "left")
    moved = rows.where("src_to IS NOT NULL OR dst_to IS NOT NULL").withColumn("ord", F.struct(F.coalesce("src_to", "src"), F.coalesce("dst_to", "dst"), "src", "dst"))
    moved = moved.withColumn("label", F.when(F.col("src_to").isNotNull(), F.col("src_label")).otherwise(F.col("dst_label"))).withColumn("canonical", F.coalesce("src_to", "dst_to"))
    moved = moved.withColumns({"src": F.coalesce("src_to", "src"), "dst": F.coalesce("dst_to", "dst")})
    inside = (F.col("src_label") == F.col("dst_label")) & (F.col("src") == F.col("dst"))
    stay = rows.where("src_to IS NULL AND dst_to IS NULL").select(*columns(EDGE))
    values = [c for c in columns(EDGE) if c not in KEY]
    found = moved.where(~inside).groupBy(*KEY).agg(F.min_by(F.struct(*values, "label", "canonical"), "ord").alias("v"), F.count("*").alias("n"))
    found = found.join(stay.select(*KEY).distinct().withColumn("had", F.lit(True)), KEY, "left")
    new = found.where("had IS NULL").select(*KEY, "v.*").select(*columns(EDGE))
    group = [F.col("v.label").alias("label"), F.col("v.canonical").alias("canonical")]
    counts = found.groupBy(*group).agg(F.count_if(F.col("had").isNull()).alias("created_edges"), F.sum(F.col("n") - F.when(F.col("had").isNull(), 1).otherwise(0)).alias("skipped_edges"))
    dropped = moved.where(inside).groupBy("label", "canonical").agg(F.count("*").alias("dropped_edges"))
    report = final.groupBy("label", "canonical").agg(F.count_if(~F.col("blocked")).alias("merged"), F.count_if("blocked").alias("errors"))
    report = report.join(counts, ["label", "canonical"], "left").join(dropped, ["label", "canonical"], "left")
    report = report.select("label", "canonical", "merged", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("created_edges", "skipped_edges", "dropped_edges")], "errors")
    return absorbed(nodes, moves), stay.unionByName(new), report


def merge_groups(nodes: DataFrame, edges: DataFrame, groups: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """merge() of a list of (label, alias, canonical)."""
    return merge(nodes, edges, nodes.sparkSession.createDataFrame(groups, "label string, alias string, canonical string"))


# Persons and the names under which they are known besides.
ALIAS_GROUPS = {
    "洪七公": ("人物", ["九指神丐", "北丐", "洪帮主", "洪恩师"]), "黄药师": ("人物", ["东邪", "黄岛主"]), "欧阳锋": ("人物", ["西毒", "欧阳先生"]),
    "周伯通": ("人物", ["老顽童"]), "王重阳": ("人物", ["中神通", "重阳真人"]), "一灯大师": ("人物", ["南帝", "段智兴"]), "丘处机": ("人物", ["长春子"]),
    "马钰": ("人物", ["丹阳子"]), "黄蓉": ("人物", ["蓉儿"]), "郭靖": ("人物", ["靖哥哥"]), "江南七怪": ("人物", ["江南六怪", "江南七侠", "六怪"]),
}
DROP_NAMES = ("师父", "大师父", "白雕", "汗血宝马", "小红马")
