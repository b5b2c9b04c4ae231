"""Scans, pattern joins and rankings on the node and edge tables.

Every limit has a total order. Nothing here collects; joins are equi-joins that Spark sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.schema import ART, SECT


def in_eras(eras: list[str]) -> Column:
    """Whether a node belongs to one of the eras: by its list of eras, or by its only one where it has no list."""
    return F.arrays_overlap(F.coalesce(F.col("eras"), F.array("era")), F.array(*map(F.lit, eras)))


def _with_eras(nodes: DataFrame) -> DataFrame:
    return nodes if "eras" in nodes.columns else nodes.withColumn("eras", F.lit(None).cast("array<string>"))


def scoped_nodes(nodes: DataFrame, eras: list[str] | None = None, labels: tuple[str, ...] | None = None) -> DataFrame:
    """name, label, era of the nodes of some eras and labels; what is not given does not filter."""
    out = nodes if eras is None else nodes.where(F.col("era").isin(*eras))
    return (out if labels is None else out.where(F.col("label").isin(*labels))).select("name", "label", "era")


def scoped_edges(nodes: DataFrame, edges: DataFrame, eras: list[str] | None) -> DataFrame:
    """Edges both of whose endpoints lie in the eras (all edges if there are none)."""
    if eras is None:
        return edges
    inside = nodes.where(F.col("era").isin(*eras)).select("label", "name")
    a = inside.select(F.col("label").alias("src_label"), F.col("name").alias("src"))
    b = inside.select(F.col("label").alias("dst_label"), F.col("name").alias("dst"))
    return edges.join(a, ["src_label", "src"], "left_semi").join(b, ["dst_label", "dst"], "left_semi")


def neighbours_any_era(nodes: DataFrame, edges: DataFrame, name: str, era: str | None) -> DataFrame:
    """Edges at a node in their true direction; with an era, one endpoint at least is in it.

    A node of several eras (eras) is in each of them; one without that list is in its era alone.
    """
    near = edges.where((F.col("src") == name) | (F.col("dst") == name))
    if era is None:
        return near
    at = _with_eras(nodes).where(in_eras([era])).select("label", "name", F.lit(True).alias("in")).distinct()
    near = near.join(at.select(F.col("label").alias("src_label"), F.col("name").alias("src"), F.col("in").alias("a")), ["src_label", "src"], "left")
    near = near.join(at.select(F.col("label").alias("dst_label"), F.col("name").alias("dst"), F.col("in").alias("b")), ["dst_label", "dst"], "left")
    return near.where("a OR b").drop("a", "b")


def directed(edges: DataFrame, relation: str, way: str) -> DataFrame:
    """cur, other and the edge, for one relation followed out, in, or both ways."""
    own = edges.where(F.col("type") == relation)
    quoted = F.coalesce(F.col("snippets"), F.array()) if "snippets" in edges.columns else F.array()
    proof = ["chunk_ids", quoted.cast("array<string>").alias("snippets")]
    out = own.select(F.col("src").alias("cur"), F.col("dst").alias("other"), "src", "dst", *proof)
    back = own.select(F.col("dst").alias("cur"), F.col("src").alias("other"), "src", "dst", *proof)
    return out if way == "out" else back if way == "in" else out.unionByName(back)


def fixed_hops(edges: DataFrame, relation: str, start: str, hops: int, way: str = "out") -> DataFrame:
    """names, depth and rels (chunk_ids and snippets of each edge) of all paths of exactly that many edges from start,
    without a return to start, by depth and names."""
    step = directed(edges, relation, way).select("cur", "other", F.struct("chunk_ids", "snippets").alias("rel"))
    paths = edges.sparkSession.range(1).select(F.array(F.lit(start)).alias("names"), F.array().cast("array<struct<chunk_ids:array<string>,snippets:array<string>>>").alias("rels"))
    for _ in range(hops):
        paths = paths.withColumn("cur", F.element_at("names", -1)).join(step, "cur")
        paths = paths.select(F.concat("names", F.array("other")).alias("names"), F.concat("rels", F.array("rel")).alias("rels"))
    return paths.where(F.element_at("names", -1) != start).select("names", F.lit(hops).alias("depth"), "rels").orderBy("depth", "names")


def traverse(edges: DataFrame, start: str, steps: list[tuple[str, str]], limit: int = 5, targets: dict[int, str] | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Simple paths along a plan's steps, the best `limit`; none if a step finds nothing.

    A node takes its first 2 * width neighbours of each direction; after each step the width best
    paths stay: those with more edges that have chunks, then with more edges that are quoted
    (snippets), then with more chunks, then by names.
    """
    width = max(10, 2 * limit)
    paths = edges.sparkSession.range(1).select(F.array(F.lit(start)).alias("names"), F.array().cast("array<struct<chunk_ids:array<string>,snippets:array<string>>>").alias("proof"))
    for k, (relation, way) in enumerate(steps):
        near = []
        for one in ("out", "in") if way == "both" else (way,):
            step = directed(edges, relation, one).where(F.col("cur") != F.col("other"))
            if targets and k in targets:
                step = step.where(F.col("other") == targets[k])
            rank = F.row_number().over(Window.partitionBy("cur").orderBy(F.col("other").contains("的"), F.desc(F.size("chunk_ids")), "other", "src", "dst"))
            reached = paths.select(F.element_at("names", -1).alias("cur")).distinct()
            near.append(step.join(reached, "cur", "left_semi").withColumn("rank", rank).where(F.col("rank") <= 2 * width).select("cur", "other", F.struct("chunk_ids", "snippets").alias("edge")))
        near = reduce(DataFrame.unionByName, near)
        if aliases is not None:
            near = near.join(aliases.select(F.col("alias").alias("other"), "canonical"), "other", "left").withColumn("other", F.coalesce("canonical", "other")).drop("canonical")
        paths = paths.withColumn("cur", F.element_at("names", -1)).join(near, "cur").where(~F.array_contains("names", F.col("other")))
        paths = paths.select(F.concat("names", F.array("other")).alias("names"), F.concat("proof", F.array("edge")).alias("proof"))
        with_ids = F.size(F.filter("proof", lambda p: F.size(p["chunk_ids"]) > 0))
        quoted = F.size(F.filter("proof", lambda p: F.size(p["snippets"]) > 0))
        total = F.aggregate("proof", F.lit(0), lambda s, p: s + F.size(p["chunk_ids"]))
        paths = paths.withColumns({"w": with_ids, "q": quoted, "t": total})
        best = [F.desc("w"), F.desc("q"), F.desc("t")]
        first = F.row_number().over(Window.partitionBy("names").orderBy(*best))
        paths = paths.withColumn("f", first).where("f = 1").orderBy(*best, "names").limit(width)
    return paths.orderBy(*best, "names").limit(limit).select("names") if steps else paths.limit(0).select("names")


def members(edges: DataFrame, relation: str, target: str) -> DataFrame:
    """Sources of one relation to a target: members, founders, practitioners."""
    return edges.where((F.col("type") == relation) & (F.col("dst") == target)).select(F.col("src").alias("name"), "chunk_ids")


def sect_arts(edges: DataFrame) -> DataFrame:
    """sect, person, art: what members of a sect know."""
    belongs = edges.where("type = 'BELONGS_TO'").select(F.col("dst").alias("sect"), F.col("src").alias("person"))
    knows = edges.where("type = 'MASTERS'").select(F.col("src").alias("person"), F.col("dst").alias("art"))
    return belongs.join(knows, "person")


def arts_grouped(arts: DataFrame, show: int = 20) -> DataFrame:
    """Per sect and art the number of persons and the first `show` of them.

    Only the first ones of each group are brought together, however many persons it has.
    """
    once = arts.select("sect", "art", "person").distinct()
    rank = F.row_number().over(Window.partitionBy("sect", "art").orderBy("person"))
    first = once.withColumn("r", rank).where(F.col("r") <= show).groupBy("sect", "art").agg(F.array_join(F.array_sort(F.collect_list("person")), ",").alias("persons"))
    counts = once.groupBy("sect", "art").agg(F.count("*").cast("int").alias("n_persons"))
    return counts.join(first, ["sect", "art"]).select("sect", "art", "n_persons", "persons")


def lineage(edges: DataFrame, art: str | None = None) -> DataFrame:
    """master, disciple, art: masters of an art and disciples of theirs who know it too.

    Without an art, those of a person are put into one array of hashes, and each pair of master and
    disciple intersects two of these; names come back at the end.
    """
    knows = edges.where("type = 'MASTERS'").select(F.col("src").alias("person"), F.col("dst").alias("art"))
    taught = edges.where("type = 'MASTER_OF' AND src != dst").select(F.col("src").alias("master"), F.col("dst").alias("disciple"))
    if art is not None:
        know = knows.where(F.col("art") == art).select("person").distinct()
        pairs = taught.join(know.withColumnRenamed("person", "master"), "master", "left_semi").join(know.withColumnRenamed("person", "disciple"), "disciple", "left_semi")
        return pairs.withColumn("art", F.lit(art)).select("master", "disciple", "art")
    held = knows.groupBy("person").agg(F.collect_set(F.xxhash64("art")).alias("arts"))
    pairs = taught.join(held.select(F.col("person").alias("disciple"), F.col("arts").alias("his")), "disciple")
    pairs = pairs.join(held.select(F.col("person").alias("master"), "arts"), "master")
    pairs = pairs.select("master", "disciple", F.explode(F.array_intersect("arts", "his")).alias("h"))
    names = knows.select(F.xxhash64("art").alias("h"), "art").distinct()
    return pairs.join(names, "h").select("master", "disciple", "art")


def expand_mentions(mentions: DataFrame, edges: DataFrame, per_chunk: int = 12) -> DataFrame:
    """Per chunk the first facts about what it mentions, in either direction."""
    both = edges.select(F.col("src").alias("name"), F.col("type"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("name"), "type", F.col("src").alias("other")))
    facts = mentions.join(both, "name").select("chunk_id", "name", "type", "other").distinct()
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy("type", "name", "other"))
    return facts.withColumn("rank", rank).where(F.col("rank") <= per_chunk)


def check_relations(rows: DataFrame, ontology: DataFrame) -> DataFrame:
    """rows (type, src_label, src, dst_label, dst) with the first reason against each, or null."""
    out = rows.join(F.broadcast(ontology.withColumnRenamed("type", "_type")), F.upper(F.trim("type")) == F.col("_type"), "left")
    reason = (
        F.when(F.col("_type").isNull(), "unknown_type")
        .when(F.coalesce(F.col("src"), F.lit("")) == "", "no_source")
        .when(F.coalesce(F.col("dst"), F.lit("")) == "", "no_target")
        .when(F.col("src") == F.col("dst"), "self_loop")
        .when(~F.coalesce(F.array_contains("domain", F.col("src_label")), F.lit(False)), "bad_domain")
        .when(~F.coalesce(F.array_contains("range", F.col("dst_label")), F.lit(False)), "bad_range")
    )
    return out.withColumn("reason", reason).drop("_type", "domain", "range", "symmetric")


def both_ways(rows: DataFrame, ontology: DataFrame) -> DataFrame:
    """rows with the reverse of each symmetric relation, without repeats."""
    out = rows.join(F.broadcast(ontology.select("type", "symmetric")), "type")
    turned = out.where("symmetric").select("type", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return out.select("type", "src", "dst").unionByName(turned).distinct()


def capped_subgraph(edges: DataFrame, max_nodes: int = 40, max_edges: int = 80) -> DataFrame:
    """Edges among the nodes of highest degree, those of the largest degree sums."""
    ends = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name")))
    top = ends.groupBy("name").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "name").limit(max_nodes)
    a = top.select(F.col("name").alias("src"), F.col("degree").alias("da"))
    b = top.select(F.col("name").alias("dst"), F.col("degree").alias("db"))
    kept = edges.join(a, "src").join(b, "dst").withColumn("weight", F.col("da") + F.col("db"))
    return kept.orderBy(F.desc("weight"), "src", "type", "dst").limit(max_edges).select("src", "type", "dst", "weight")


def with_path_edges(subgraph: DataFrame, path: DataFrame) -> DataFrame:
    """The edges (src, type, dst) of a subgraph, and those of a path that it lacks."""
    keys = ["src", "type", "dst"]
    return subgraph.select(*keys).unionByName(path.select(*keys).distinct().join(subgraph.select(*keys), keys, "left_anti"))


def sect_own_arts(edges: DataFrame, sect: str) -> DataFrame:
    """Arts that a sect itself is said to master; the ontology has none, other data may."""
    return edges.where((F.col("type") == "MASTERS") & (F.col("src_label") == SECT) & (F.col("src") == sect)).select(F.col("dst").alias("art"), "chunk_ids")


def art_founders(edges: DataFrame, art: str) -> DataFrame:
    """Persons who are said to have founded an art; the ontology has none, other data may."""
    return edges.where((F.col("type") == "FOUNDER_OF") & (F.col("dst_label") == ART) & (F.col("dst") == art)).select(F.col("src").alias("person"), "chunk_ids")
