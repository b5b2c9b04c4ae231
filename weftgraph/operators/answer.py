"""Questions: intents, retrieval methods, evidence, and how answers are judged."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import affirmed, era_scope
from weftgraph.operators import graph, match
from weftgraph.schema import ART, PERSON, SECT

# The words that decide an intent.
FOUNDING = ("创立", "创建", "创办", "开创", "所创", "创下", "开派", "建立")
ART_WORDS = ("传承", "谁传", "传给谁", "传给了", "传给", "谁传授", "创始人", "谁创", "源自", "流自", "从谁", "演化")
SECT_WORDS = ("绝学", "成员", "门下", "有哪些", "掌门", "帮主", "什么武功", "会什么", "创始人", "谁创", *FOUNDING)
MASTER_WORDS = ("师父", "师傅", "师祖", "太师父", "徒弟", "弟子", "师承", "师从", "师门", "门徒", "恩师")
KIN_WORDS = (
    "父亲", "母亲", "爸爸", "妈妈", "爹", "娘", "儿子", "女儿", "子女", "孩子", "父母", "父子", "父女", "母子", "母女", "爹娘", "配偶", "妻子",
    "丈夫", "老婆", "老公", "夫人", "娘子", "夫妻", "结拜", "义兄", "义弟", "结义", "义结金兰", "仇敌", "敌人", "对手", "死对头", "仇人",
    "岳父", "岳母", "外公", "外婆", "孙子", "孙女",
)
COMPARE_WORDS = ("谁厉害", "谁强", "谁更", "比较", "区别", "对比", "哪个厉害", "谁武功高", "谁高")
CROSS_WORDS = ("跨书", "血缘", "后人", "之后人", "关联", "什么关系", "有何关系", "几代", "时代差异")
SKILL_WORDS = ("精通", "掌法", "棒法", "剑法", "拳法", "刀法", "棍法", "指法", "爪法", "绝技", "绝学", "成名武功", "独门武功", "所学武功")
WHERE_WORDS = ("属于哪个门派", "哪个帮派", "哪个门派", "来自哪里", "来自何处", "创立的门派", "创立了什么门派", "哪里的岛主", "哪里的")
DOWN_WORDS = ("徒弟", "弟子", "徒儿", "门徒", "传人")

METHODS: dict[str, Callable] = {}


def register(name: str):
    """Decorator that adds a retrieval method; a name is taken once."""

    def add(method: Callable) -> Callable:
        if name in METHODS:
            raise ValueError(f"{name} is taken")
        METHODS[name] = method
        return method

    return add


def classify(questions: DataFrame, question: str = "question", people: str = "people", sects: str = "sects", arts: str = "arts") -> DataFrame:
    """questions with intent and method, from the arrays of entities that were linked in each."""
    text = F.col(question)

    def says(words: tuple[str, ...]) -> Column:
        return text.rlike("|".join(words))

    person, sect, art = (F.size(c) > 0 for c in (people, sects, arts))
    two = F.size(people) > 1
    scoped = F.size(era_scope(text)) > 0
    rules = [
        (two & (says(CROSS_WORDS) | (scoped & says(("关联", "关系")))), "cross_novel", "cross_novel"),
        (art & says(ART_WORDS), "art", "art_lineage"),
        (sect & says(SECT_WORDS), "sect", "sect_agg"),
        (person & says(FOUNDING), "sect", "sect_agg"),
        (person & (says(SKILL_WORDS) | says(WHERE_WORDS)), "general", "vector"),
        (person & says(KIN_WORDS), "person_relation", "person_relation"),
        (person & says(COMPARE_WORDS), "general", "vector"),
        (person & says(MASTER_WORDS), "person", "master_chain"),
    ]
    intent = reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), F.lit("general"))
    method = reduce(lambda rest, r: F.when(r[0], r[2]).otherwise(rest), reversed(rules), F.lit("vector"))
    return questions.withColumns({"intent": intent, "method": method})


def chain_length(question: Column) -> Column:
    """Steps of a master chain that a question asks for (1 to 4)."""
    named = F.regexp_count(question, F.lit("师父|师傅"))
    least = F.when(question.contains("太师父"), 3).when(question.contains("师祖"), 2).otherwise(1)
    return F.least(F.greatest(named, least), F.lit(4))


@register("master_chain")
def master_chain(edges: DataFrame, name: str, hops: int = 1, way: str = "in", k: int = 5, relation: str = "MASTER_OF") -> DataFrame:
    """The first k simple chains of masters (in) or disciples (out) with exactly that many steps: names, depth, rels."""
    paths = match.fixed_hops(edges, relation, name, hops, way).dropDuplicates(["names"])
    return paths.where(F.size(F.array_distinct("names")) == hops + 1).orderBy("depth", "names").limit(k)


@register("sect_agg")
def sect_agg(edges: DataFrame, sect: str, what: str = "members", k: int = 5) -> DataFrame:
    """Members, founders or arts of a sect, or the sects that a person founded: name, n_chunks."""
    if what == "arts":
        rows = match.sect_arts(edges).where(F.col("sect") == sect).groupBy(F.col("art").alias("name")).agg(F.count_distinct("person").alias("n_chunks"))
    elif what == "founded":
        rows = edges.where((F.col("type") == "FOUNDER_OF") & (F.col("src") == sect)).select(F.col("dst").alias("name"), F.size("chunk_ids").alias("n_chunks"))
    else:
        rows = match.members(edges, "FOUNDER_OF" if what == "founders" else "BELONGS_TO", sect).select("name", F.size("chunk_ids").alias("n_chunks"))
    return rows.orderBy(F.desc("n_chunks"), "name").limit(k)


@register("art_lineage")
def art_lineage(edges: DataFrame, art: str, what: str = "lineage", k: int = 5) -> DataFrame:
    """src, dst, confidence of an art's origin, practitioners, or lineage (practitioners if there is none).

    An edge is extracted if it has chunks, else it is inferred.
    """
    sure = F.when(F.size("chunk_ids") > 0, "extracted").otherwise("inferred").alias("confidence")
    if what == "origin":
        founded = match.art_founders(edges, art).select(F.col("person").alias("src"), F.lit(art).alias("dst"), sure)
        rows = edges.where((F.col("type") == "BRANCHED_FROM") & (F.col("src") == art)).select("src", "dst", sure).unionByName(founded)
    else:
        rows = match.members(edges, "MASTERS", art).select(F.col("name").alias("src"), F.lit(art).alias("dst"), sure)
        if what == "lineage":
            taught = edges.where("type = 'MASTER_OF'").select(F.col("src").alias("master"), F.col("dst").alias("disciple"), sure)
            passed = match.lineage(edges, art).join(taught, ["master", "disciple"]).select(F.col("master").alias("src"), F.col("disciple").alias("dst"), "confidence")
            rows = passed if passed.limit(1).count() else rows
    return rows.orderBy("src", "dst").limit(k)


@register("person_relation")
def person_relation(edges: DataFrame, name: str, steps: list[tuple[str, str]], k: int = 5) -> DataFrame:
    return match.traverse(edges, name, steps, k)


def _blood(reached: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """reached (keys, path) with blood: whether a step of the path is one from an ancestor to a descendant."""
    kin = edges.where("type = 'DESCENDANT_OF'").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("step")).distinct()
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: F.struct(F.get("path", i - 1).alias("a"), F.get("path", i).alias("b")))
    blood = reached.select(*keys, F.explode(steps).alias("step")).join(kin, "step", "left_semi").select(*keys).distinct().withColumn("blood", F.lit(True))
    return reached.join(blood, keys, "left").withColumn("blood", F.coalesce("blood", F.lit(False)))


@register("cross_novel")
def cross_novel(nodes: DataFrame, edges: DataFrame, name: str, k: int = 5, hops: int = 4) -> DataFrame:
    """Persons of other eras within so many hops, blood relations first: name, distance, blood."""
    reached = _blood(graph.bfs(edges, name, hops), edges, ["name"])
    home = nodes.where((F.col("label") == PERSON) & (F.col("name") == name)).select(F.col("era").alias("home"))
    people = nodes.where(F.col("label") == PERSON).select("name", "era")
    eras = [r["home"] for r in home.limit(1).collect()]
    out = reached.where(F.col("name") != name).join(people, "name").where(~F.col("era").eqNullSafe(F.lit(eras[0] if eras else None)))
    return out.select("name", "distance", "blood").orderBy(F.desc("blood"), "distance", "name").limit(k)


def cross_pairs(edges: DataFrame, names: list[str], k: int = 5, hops: int = 4) -> DataFrame:
    """The shortest paths between each two of some names, blood relations first: source, name, distance, path, blood.

    One search from each name but the last finds its paths to all that follow.
    """
    found = []
    for i, source in enumerate(names[:-1]):
        reached = graph.bfs(edges, source, hops).where(F.col("name").isin(*names[i + 1 :]) & (F.col("name") != source))
        found.append(reached.select(F.lit(source).alias("source"), "name", "distance", "path"))
    rows = _blood(reduce(DataFrame.unionByName, found), edges, ["source", "name"])
    return rows.select("source", "name", "distance", "path", "blood").orderBy(F.desc("blood"), "distance", "name", "source").limit(k)


def bundle(edges: DataFrame) -> DataFrame:
    """edges as evidence: nodes (label::name), arrows, sorted distinct chunk ids, confidence."""
    node = lambda label, name: F.concat(F.coalesce(F.nullif(label, F.lit("")), F.lit("实体")), F.lit("::"), name)
    return edges.select(
        node(F.col("src_label"), F.col("src")).alias("source"), node(F.col("dst_label"), F.col("dst")).alias("target"), "type",
        F.array_join(F.array_sort(F.array_distinct("chunk_ids")), ",").alias("chunk_ids"),
        F.when(F.size("chunk_ids") > 0, "extracted").otherwise("inferred").alias("confidence"),
        F.format_string("%s -[%s]-> %s", "src", "type", "dst").alias("line"),
    )


def judge(rows: DataFrame, answer: str = "answer", accepted: str = "accepted") -> DataFrame:
    """rows with hit: whether an accepted answer occurs without a negation before it."""
    return rows.withColumn("hit", F.exists(accepted, lambda a: affirmed(F.col(answer), a)))


def precision_recall(expected: Column, answered: Column) -> tuple[Column, Column, Column]:
    """Recall of the expected names, precision (1 if any matches), and F1, rounded to 4 places."""
    found = F.size(F.array_intersect(expected, answered))
    recall = F.when(F.size(expected) > 0, found / F.size(expected)).otherwise(0.0)
    precision = F.when(found > 0, 1.0).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return F.round(recall, 4), precision, F.round(f1, 4)


def category(question_kind: Column) -> Column:
    return F.when(question_kind.rlike("武功|传承"), "武功").when(question_kind.rlike("门派|帮派"), "门派").when(question_kind.rlike("比较|综合"), "综合").otherwise("人物")


def path_valid(path: Column) -> Column:
    """Whether consecutive edges (source, target) of a path meet."""
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(path) - 1, F.lit(1))), lambda i: (i >= F.size(path)) | (F.get(path, i - 1)["target"] == F.get(path, i)["source"]))


LINKED = {"people": PERSON, "sects": SECT, "arts": ART}


def by_label(links: str = "links") -> dict[str, Column]:
    """Columns people, sects, arts: the canonical names of an array of links."""
    return {k: F.transform(_of(links, v), lambda e: e["canonical"]) for k, v in LINKED.items()}


def _of(links: str, label: str) -> Column:
    return F.filter(links, lambda e: e["label"] == label)
