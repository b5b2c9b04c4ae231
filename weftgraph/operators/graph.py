"""Graph algorithms on an edge table (src, dst); nodes are identified by name.

Loops are bounded and cut their lineage by a checkpoint in the folder that the session names, so
that a lost executor costs no more than one round.
"""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df without lineage, by a reliable checkpoint in the folder that the session names.

    Executors of a cluster share no folder of their own, so only a local session may go without.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="weft-checkpoint-")
        context.setCheckpointDir(where)
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) in both directions, a self-loop once."""
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def adjacency(names: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """name, other and the edge (src, type, dst) from each of its ends, a self-loop once.

    Several edges between two names are several rows; edges to names that there are not go.
    """
    known = names.select("name").distinct()
    kept = edges.join(known.withColumnRenamed("name", "src"), "src", "left_semi").join(known.withColumnRenamed("name", "dst"), "dst", "left_semi")
    out = kept.select(F.col("src").alias("name"), F.col("dst").alias("other"), "src", "type", "dst")
    back = kept.where("src != dst").select(F.col("dst").alias("name"), F.col("src").alias("other"), "src", "type", "dst")
    return out if directed else out.unionByName(back)


def degree_centrality(names: DataFrame, edges: DataFrame, top_k: int | None = None) -> DataFrame:
    """name, degree (distinct neighbours) and centrality of all names, isolated ones too, or of the first top_k.

    Names travel as 64-bit hashes.
    """
    n = names.count()
    ends = edges.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"))
    near = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degrees = near.groupBy("a").agg(F.count("*").alias("degree"))
    out = names.withColumn("a", F.xxhash64("name")).join(degrees, "a", "left").drop("a").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    out = out.withColumn("centrality", F.round(F.col("degree") / max(n - 1, 1), 6))
    return out if top_k is None else out.orderBy(F.desc("centrality"), "name").limit(max(top_k, 0))


def pagerank(names: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-8, top_k: int | None = None) -> DataFrame:
    """name, rank of all or of the first top_k; stops after so many rounds or when ranks move by less than the tolerance."""
    n = names.count()
    if not n:
        return names.select("name", F.lit(0.0).alias("rank"))
    near = undirected(edges).join(names.select(F.col("name").alias("a")), "a", "left_semi").join(names.select(F.col("name").alias("b")), "b", "left_semi")
    share = near.groupBy("a").agg(F.count("*").alias("out"))
    links = cut(near.join(share, "a"))
    ranks = names.select("name").join(share.select(F.col("a").alias("name"), "out"), "name", "left").withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        lost = ranks.where("out IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")).first()["lost"]
        sent = links.join(ranks.select(F.col("name").alias("a"), "rank"), "a").groupBy(F.col("b").alias("name")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = ranks.withColumnRenamed("rank", "old").join(sent, "name", "left")
        base = (1 - damping) / n + damping * lost / n
        new = new.withColumn("rank", F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).drop("got")
        new = cut(new) if k % 5 == 4 or tolerance is not None else new
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] if tolerance is not None else 1.0
        ranks = new.drop("old")
        if tolerance is not None and moved < tolerance:
            break
    ranks = ranks.select("name", F.round("rank", 8).alias("rank"))
    return ranks if top_k is None else ranks.orderBy(F.desc("rank"), "name").limit(max(top_k, 0))


def top_degrees(edges: DataFrame, k: int = 20) -> DataFrame:
    """The k names with most edges, every edge counting at both its ends."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name"))
    return ends.groupBy("name").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "name").limit(k)


def bfs(edges: DataFrame, source: str, max_hops: int, target: str | None = None) -> DataFrame:
    """name, distance and the lexicographically smallest path to all reached names.

    With a target the search ends at the level that reaches it.
    """
    spark = edges.sparkSession
    near = cut(undirected(edges).where("a != b"))
    seen = spark.createDataFrame([(source, 0, [source])], "name string, distance int, path array<string>")
    level = seen
    for hop in range(1, max_hops + 1):
        if target is not None and level.where(F.col("name") == target).limit(1).count():
            break
        reached = level.join(near, level["name"] == near["a"]).select(F.col("b").alias("name"), F.concat("path", F.array("b")).alias("path"))
        new = reached.join(seen.select("name"), "name", "left_anti").groupBy("name").agg(F.min("path").alias("path"))
        level = cut(new.select("name", F.lit(hop).alias("distance"), "path"))
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int = 4) -> DataFrame:
    """The one row of bfs() for the target, or none if it is farther than max_hops."""
    return bfs(edges, source, max_hops, target).where(F.col("name") == target)


def louvain(edges: DataFrame, passes: int = 20) -> DataFrame:
    """name, community by one level of greedy local moves, in the order of names.

    Each move depends on all before it, so the graph has to fit one task; communities() and
    label_propagation() are the distributed alternatives, with other communities.
    """

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set[str]] = {}
        for a, b in pairs.itertuples(index=False):
            near.setdefault(a, set()).add(b)
        order = sorted(near)
        home, degree = {v: i for i, v in enumerate(order)}, {v: len(near[v]) for v in order}
        total, load = float(sum(degree.values())), {i: degree[v] for i, v in enumerate(order)}
        for _ in range(passes if total else 0):
            moved = False
            for v in order:
                old = home[v]
                load[old] -= degree[v]
                into: dict[int, int] = {}
                for u in near[v]:
                    if u != v:
                        into[home[u]] = into.get(home[u], 0) + 1
                best, gain = old, 0.0
                for c in sorted(into):
                    g = (into[c] - into.get(old, 0)) / total - degree[v] * (load[c] - load[old]) / total**2
                    if g > gain + 1e-12:
                        best, gain = c, g
                home[v] = best
                load[best] += degree[v]
                moved |= best != old
            if not moved:
                break
        names: dict[int, int] = {}
        return pd.DataFrame({"name": order, "community": [names.setdefault(home[v], len(names)) for v in order]})

    def whole(frames):
        parts = list(frames)
        if parts:
            yield run(pd.concat(parts))

    return undirected(edges).coalesce(1).mapInPandas(whole, "name string, community long")


def communities(edges: DataFrame, rounds: int = 16) -> DataFrame:
    """name, community (the name of one of its members) by local moves that raise modularity, made by all at once.

    The distributed form of louvain()'s level, with other communities of like modularity. In a round a
    random half of the names moves, each to the community of its neighbours that gains most (of equally good ones
    the first by hash); of two that stand alone only one joins the other. It ends after two rounds in
    which nobody moved.
    """
    near = cut(undirected(edges).where("a != b"))
    total = near.count()
    home = cut(near.groupBy(F.col("a").alias("name")).agg(F.count("*").alias("k")).withColumn("c", F.col("name")))
    idle = 0
    for step in range(rounds if total else 0):
        load = home.groupBy("c").agg(F.sum("k").alias("load"), F.count("*").alias("size"))
        into = near.join(home.select(F.col("name").alias("b"), "c"), "b").groupBy(F.col("a").alias("name"), "c").agg(F.count("*").alias("w"))
        stay = home.select("name", F.col("c").alias("own"), "k").join(load.select(F.col("c").alias("own"), F.col("load").alias("own_load"), F.col("size").alias("own_size")), "own")
        seen = into.join(stay, "name").join(load, "c")
        rest = F.col("load") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0)
        seen = seen.withColumn("gain", F.col("w") - F.col("k") * rest / total)
        alone = (F.col("own_size") == 1) & (F.col("size") == 1) & (F.col("c") > F.col("own"))
        best = F.max(F.when((F.col("c") != F.col("own")) & ~alone, F.struct("gain", (-F.xxhash64("c")).alias("h"), "c"))).alias("best")
        here = F.max(F.when(F.col("c") == F.col("own"), F.col("gain")))
        judged = seen.groupBy("name", "own", "k", "own_load").agg(best, F.coalesce(here, -F.first("k") * (F.first("own_load") - F.first("k")) / total).alias("here"))
        may = (F.pmod(F.xxhash64("name", F.lit(step)), F.lit(2)) == 0) & (F.col("best")["gain"] > F.col("here") + 1e-9)
        new = cut(judged.select("name", "k", F.when(may, F.col("best")["c"]).otherwise(F.col("own")).alias("c"), F.coalesce(may, F.lit(False)).alias("moved")))
        idle = 0 if new.where("moved").limit(1).count() else idle + 1
        home = new.select("name", "k", "c")
        if idle == 2:
            break
    return home.select("name", F.col("c").alias("community"))


def modularity(edges: DataFrame, found: DataFrame) -> float:
    """Modularity of communities (name, community) of the graph without its loops."""
    near = undirected(edges).where("a != b").join(found.select(F.col("name").alias("a"), F.col("community").alias("x")), "a").join(found.select(F.col("name").alias("b"), F.col("community").alias("y")), "b")
    sums = near.groupBy("x").agg(F.count("*").alias("load"), F.count_if(F.col("x") == F.col("y")).alias("inside"))
    total = F.sum("load")
    row = sums.agg(total.alias("n"), F.sum("inside").alias("inside"), F.sum(F.col("load").cast("double") * F.col("load")).alias("squares")).first()
    return row["inside"] / row["n"] - row["squares"] / row["n"] ** 2 if row["n"] else 0.0


def label_propagation(names: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """name, label: the commonest label of the neighbours, of equally common ones the smallest."""
    near = cut(undirected(edges).where("a != b"))
    labels = names.select("name", F.col("name").alias("label"))
    for _ in range(rounds):
        votes = near.join(labels.select(F.col("name").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
        won = votes.groupBy(F.col("a").alias("name")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("w"))
        labels = cut(labels.join(won, "name", "left").select("name", F.coalesce("w.label", "label").alias("label")))
    return labels


def analyze(names: DataFrame, edges: DataFrame, top_k: int = 10) -> DataFrame:
    """One table of what is central: kind (degree, pagerank, community), name, value, rank.

    Of degree and PageRank the first top_k; of communities every name with its number, members in
    the order of their names.
    """
    degree = degree_centrality(names, edges, top_k).select(F.lit("degree").alias("kind"), "name", F.col("centrality").alias("value"))
    rank = pagerank(names, edges, top_k=top_k).select(F.lit("pagerank").alias("kind"), "name", F.col("rank").alias("value"))
    group = louvain(edges).select(F.lit("community").alias("kind"), "name", F.col("community").cast("double").alias("value"))
    order = Window.partitionBy("kind").orderBy(F.desc("value"), "name")
    inside = Window.partitionBy("kind", "value").orderBy("name")
    return degree.unionByName(rank).withColumn("rank", F.row_number().over(order)).unionByName(group.withColumn("rank", F.row_number().over(inside)))
