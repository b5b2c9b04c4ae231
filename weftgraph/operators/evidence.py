"""Evidence of answers in one shape, and the contexts that generators read.

A bundle is a row, so that evidence of any number of questions is brought into shape, named and written
out by columns; a question's bundles in their order are an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.linking import injection_name  # noqa: F401  part of this interface
from weftgraph.schema import PERSON

# What relations are called in contexts.
CALLED = {
    "MASTER_OF": "师徒", "SPOUSE_OF": "夫妻", "PARENT_OF": "父母", "SWORN_BROTHER_OF": "结拜", "ENEMY_OF": "仇敌", "BELONGS_TO": "属于", "MASTERS": "精通",
    "FOUNDER_OF": "创立", "LOCATED_IN": "位于", "BRANCHED_FROM": "演化", "DESCENDANT_OF": "血缘（祖先→后代）",
}
ARROWS = {"forward": "->", "backward": "<-", "symmetric": "--"}
NO_LABEL, INFERRED, QUOTED = "实体", "（推断）", "｜原文："
QUOTE, EXCERPT, BUDGET = 60, 400, 6000

NODES = "array<struct<id:string,name:string,type:string,era:string>>"
EDGES = "array<struct<source:string,target:string,type:string,direction:string,chunk_ids:array<string>,snippets:array<string>,confidence:string>>"
BUNDLE = f"struct<kind:string,source_method:string,confidence:string,seed:string,complete:boolean,nodes:{NODES},edges:{EDGES},chunk_ids:array<string>,text:string>"

#: Columns that evidence of one shape or another has.
_SHAPES = {
    "name": "string", "depth": "int", "from": "string", "to": "string", "person": "string", "arts": "array<string>", "source": "string", "target": "string", "type": "string", "rel": "string",
    "direction": "string", "confidence": "string", "chunk_id": "string", "text": "string", "content": "string", "score": "double", "era": "string",
}


def entity_id(name: Column, label: Column) -> Column:
    """Label and name in one text; empty for no name."""
    name = F.trim(F.coalesce(name, F.lit("")))
    return F.when(name == "", "").otherwise(F.concat(F.coalesce(F.nullif(label, F.lit("")), F.lit(NO_LABEL)), F.lit("::"), name))


def node(name: Column, label: Column, era: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(entity_id(name, label).alias("id"), F.trim(F.coalesce(name, F.lit(""))).alias("name"), label.cast("string").alias("type"), (none if era is None else era).alias("era"))


def edge(source: Column, target: Column, kind: Column, direction: Column | None = None, confidence: Column | None = None, chunk_ids: Column | None = None, snippets: Column | None = None) -> Column:
    none, said = F.array().cast("array<string>"), lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.struct(
        said(source).alias("source"), said(target).alias("target"), F.upper(said(kind)).alias("type"), F.coalesce(direction, F.lit("forward")).alias("direction") if direction is not None else F.lit("forward").alias("direction"),
        (none if chunk_ids is None else F.coalesce(chunk_ids, none)).alias("chunk_ids"), (none if snippets is None else F.coalesce(snippets, none)).alias("snippets"),
        (F.lit("extracted") if confidence is None else F.coalesce(confidence, F.lit("extracted"))).alias("confidence"),
    )


def normalized(rows: DataFrame, method: str) -> DataFrame:
    """rows of any of the shapes that methods gave evidence in, with bundle, the shape that they share.

    A row is a step of a chain (name, depth), of a lineage (from, to), a member (person, arts), a
    triple (source, target) or a chunk (chunk_id, or text and score), in this order.
    """
    there = rows.withColumns({c: F.lit(None).cast(t) for c, t in _SHAPES.items() if c not in rows.columns})
    c = {name: F.col(f"`{name}`") for name in _SHAPES}
    has = lambda *names: [c[n].isNotNull() for n in names]
    both = lambda a, b: has(a)[0] & has(b)[0]
    empty_nodes, empty_edges = F.array().cast(NODES), F.array().cast(EDGES)
    person = F.lit(PERSON)

    def made(kind: str, nodes: Column, edges: Column, text: Column, ids: Column | None = None) -> Column:
        found = F.array_sort(F.array_distinct(F.flatten(F.transform(edges, lambda e: e["chunk_ids"])))) if ids is None else ids
        return F.struct(F.lit(kind).alias("kind"), F.lit(method).alias("source_method"), F.lit("extracted").alias("confidence"), F.lit(None).cast("string").alias("seed"), F.lit(True).alias("complete"),
                        nodes.cast(NODES).alias("nodes"), edges.cast(EDGES).alias("edges"), found.cast("array<string>").alias("chunk_ids"), F.coalesce(text, F.lit("")).alias("text")).cast(BUNDLE)

    chain = made("chain", F.array(node(c["name"], person, c["era"])), empty_edges, F.format_string("%s（第%d代）", c["name"], c["depth"]))
    lineage = made("art", empty_nodes, F.array(edge(c["from"], c["to"], F.lit("MASTER_OF"), confidence=F.coalesce(c["confidence"], F.lit("inferred")))), F.concat(c["from"], F.lit(" -> "), c["to"]))
    known = F.transform(F.coalesce(c["arts"], F.array().cast("array<string>")), lambda a: edge(c["person"], a, F.lit("MASTERS")))
    member = made("member", F.array(node(c["person"], person)), known, F.concat_ws("：", c["person"], F.array_join(c["arts"], "、")))
    said = F.coalesce(c["type"], c["rel"])
    triple = made("triple", empty_nodes, F.array(edge(c["source"], c["target"], said, c["direction"], c["confidence"])), F.concat_ws(" ", c["source"], said, c["target"]))
    ids = F.when(c["chunk_id"].isNotNull(), F.array(c["chunk_id"])).otherwise(F.array().cast("array<string>"))
    chunk = made("chunk", empty_nodes, empty_edges, F.substring(F.coalesce(c["text"], c["content"]), 1, EXCERPT), ids)
    bundle = F.when(both("name", "depth"), chain).when(both("from", "to"), lineage).when(has("person")[0] | has("arts")[0], member).when(both("source", "target"), triple).otherwise(chunk)
    return there.select(*rows.columns, bundle.alias("bundle"))


def entity_names(bundles: Column) -> Column:
    """Names in an array of bundles, each once, in the order they come."""
    each = lambda b: F.concat(F.transform(b["nodes"], lambda n: n["name"]), F.flatten(F.transform(b["edges"], lambda e: F.array(e["source"], e["target"]))))
    return F.filter(F.array_distinct(F.flatten(F.transform(bundles, each))), lambda n: n != "")


def path_of(bundles: Column, seed: Column) -> Column:
    """struct of nodes and edges ([source, target]) that an array of bundles leads over; the seed alone if there are none."""
    names = entity_names(bundles)
    steps = F.array_distinct(F.flatten(F.transform(bundles, lambda b: F.transform(b["edges"], lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), e["type"].alias("type"))))))
    alone = F.when(F.coalesce(seed, F.lit("")) != "", F.array(seed)).otherwise(F.array().cast("array<string>"))
    return F.struct(F.when(F.size(names) > 0, names).otherwise(alone).alias("nodes"), F.transform(steps, lambda s: F.array(s["source"], s["target"])).alias("edges"))


def facts(bundles: Column) -> Column:
    """Distinct facts (src, type, dst) of an array of bundles, for all encodings alike; what a bundle without edges names is one too."""
    of_edges = lambda b: F.transform(b["edges"], lambda e: F.struct(e["source"].alias("src"), e["type"].alias("type"), e["target"].alias("dst")))
    of_nodes = lambda b: F.transform(b["nodes"], lambda n: F.struct(n["name"].alias("src"), F.lit("实体").alias("type"), F.lit("").alias("dst")))
    every = F.flatten(F.transform(bundles, lambda b: F.when(F.size(b["edges"]) > 0, of_edges(b)).otherwise(of_nodes(b))))
    return F.array_distinct(F.filter(every, lambda f: (f["src"] != "") & (f["type"] != "") & ((f["dst"] != "") | (f["type"] == "实体"))))


def called(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in CALLED.items()], kind)


def _edge_line(e: Column, forward: bool = False) -> Column:
    arrow = F.lit("->") if forward else F.coalesce(*[F.when(e["direction"] == k, v) for k, v in ARROWS.items()], F.lit("->"))
    quotes = F.filter(e["snippets"], lambda s: s != "")
    quote = F.when(F.size(quotes) > 0, F.concat(F.lit(QUOTED), F.substring(F.get(quotes, F.lit(0)), 1, QUOTE))).otherwise("")
    sure = F.when(e["confidence"] == "inferred", INFERRED).otherwise("")
    return F.concat(e["source"], F.lit(" "), arrow, F.lit("["), called(e["type"]), F.lit("] "), e["target"], sure, quote)


def _texts(bundles: Column) -> Column:
    return F.filter(F.transform(bundles, lambda b: b["text"]), lambda t: t != "")


def _path_lines(bundles: Column) -> Column:
    return F.flatten(F.transform(bundles, lambda b: F.when(b["kind"] == "chunk", F.array(b["text"])).otherwise(F.transform(b["edges"], lambda e: _edge_line(e)))))


def _triple_lines(bundles: Column) -> Column:
    triple = lambda e: F.concat(F.lit("（"), e["source"], F.lit("，"), called(e["type"]), F.lit("，"), e["target"], F.lit("）"))
    named = lambda b: F.transform(b["nodes"], lambda n: n["name"])
    return F.flatten(F.transform(bundles, lambda b: F.when(b["kind"] == "chunk", F.array(b["text"])).when(F.size(b["edges"]) > 0, F.transform(b["edges"], triple)).otherwise(named(b))))


def _person_lines(bundles: Column) -> Column:
    whole = F.filter(bundles, lambda b: (b["kind"] == "path") & b["complete"] & (F.size(b["edges"]) > 0))
    return F.transform(whole, lambda b: F.array_join(F.transform(b["edges"], lambda e: _edge_line(e, True)), "；"))


def _sect_lines(bundles: Column) -> Column:
    def body(b: Column) -> Column:
        founded = F.transform(F.filter(b["edges"], lambda e: e["type"] == "FOUNDER_OF"), lambda e: F.concat(e["source"], F.lit(" 创立 "), e["target"]))
        people = F.array_distinct(F.transform(F.filter(b["edges"], lambda e: e["type"].isin("BELONGS_TO", "MASTERS")), lambda e: e["source"]))

        def line(p: Column) -> Column:
            arts = F.transform(F.filter(b["edges"], lambda e: (e["type"] == "MASTERS") & (e["source"] == p)), lambda e: e["target"])
            return F.when(F.size(arts) > 0, F.concat(p, F.lit("（会："), F.array_join(arts, "、"), F.lit("）"))).otherwise(p)

        return F.concat(founded, F.transform(F.filter(people, lambda p: p != ""), line))

    each = F.transform(bundles, lambda b: F.struct(F.coalesce(b["seed"], F.lit("")).alias("seed"), body(b).alias("lines")))
    titled = F.filter(each, lambda x: (x["seed"] != "") & (F.size(x["lines"]) > 0))
    titles = F.transform(F.reverse(titled), lambda x: F.concat(F.lit("门派："), x["seed"]))
    return F.concat(titles, F.flatten(F.transform(each, lambda x: x["lines"])))


def within(lines: Column, budget: int) -> Column:
    """Distinct, non-empty lines until one would pass the budget; the first always stays."""
    clean = F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def add(s: Column, x: Column) -> Column:
        full = s["full"] | ((F.size(s["out"]) > 0) & (s["used"] + F.length(x) > budget))
        return F.when(full, F.struct(s["out"].alias("out"), s["used"].alias("used"), F.lit(True).alias("full"))).otherwise(
            F.struct(F.concat(s["out"], F.array(x)).alias("out"), (s["used"] + F.length(x) + 1).alias("used"), F.lit(False).alias("full")))

    return F.aggregate(clean, start, add, lambda s: s["out"])


def context(method: Column, bundles: Column, raw: Column, budget: int = BUDGET) -> Column:
    """What a generator reads of an array of bundles, in the form of the method that found them."""
    raw = F.trim(F.coalesce(raw, F.lit("")))
    text = F.when(raw != "", F.array(raw)).otherwise(_texts(bundles))
    first = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    paths = first(_path_lines(bundles), _triple_lines(bundles))
    lines = (
        F.when(method == "sect_agg", first(_sect_lines(bundles), text)).when(method == "person_relation", first(_person_lines(bundles), _triple_lines(bundles)))
        .when(method.isin("cross_novel", "master_chain", "art_lineage"), paths).otherwise(text)
    )
    return F.array_join(within(F.when((F.size(lines) == 0) & (raw != ""), F.array(raw)).otherwise(lines), budget), "\n")
