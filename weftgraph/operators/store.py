"""Merges of nodes, edges, chunks and mentions as ordered aggregations, and graph maintenance.

Plain Parquet has no MERGE: the old rows and the new ones are united, and each key is aggregated
in the order of `ord`, which puts the old ones first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import cut


def first_seen(value: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.min_by(value, F.when(F.col(value).isNotNull() & (F.col(value) != ""), F.col("ord")))


def appended(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Per key the distinct non-empty values of rows, as an array in the order of first appearance.

    Each value is reduced to its first row before the values of a key meet, so a key of very many
    rows brings no more than its distinct values together.
    """
    first = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.min("ord").alias("_o"))
    held = F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v"))))
    return first.groupBy(*keys).agg(F.transform(held, lambda x: x["v"]).alias(name))


def _with_appended(out: DataFrame, rows: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    for value, name in values.items():
        out = out.join(appended(rows, keys, value, name), keys, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def merge_nodes(rows: DataFrame) -> DataFrame:
    """rows (ord, label, name, era, book, description, location, art_type) merged by (label, name).

    Eras, locations and art types are the first seen; the longest description stays, the earlier
    one of equally long ones.
    """
    size = F.struct(F.length("description").alias("n"), (-F.col("ord")).alias("o"))
    out = rows.groupBy("label", "name").agg(
        first_seen("era").alias("era"), first_seen("location").alias("location"), first_seen("art_type").alias("art_type"),
        F.max_by("description", F.when(F.length("description") > 0, size)).alias("description"),
    )
    return _with_appended(out, rows, ["label", "name"], {"era": "eras", "book": "books"})


def merge_edges(rows: DataFrame) -> DataFrame:
    """rows (ord, type, src_label, src, dst_label, dst, chunk_id, snippet, era, book, and version if they have it) merged by edge."""
    keys = ["type", "src_label", "src", "dst_label", "dst"]
    out = rows.groupBy(*keys).agg(first_seen("chunk_id").alias("chunk_id"))
    grow = {"chunk_id": "chunk_ids", "snippet": "snippets", "era": "eras", "book": "books", "version": "versions"}
    return _with_appended(out, rows, keys, {value: name for value, name in grow.items() if value in rows.columns})


def merge_mentions(rows: DataFrame) -> DataFrame:
    """rows (chunk_id, label, name, or fewer of these) once each."""
    return rows.distinct()


def merge_chunks(rows: DataFrame) -> DataFrame:
    """rows (ord, chunk_id, text, embedding): the last text; the last embedding that is not null."""
    return rows.groupBy("chunk_id").agg(F.max_by("text", "ord").alias("text"), F.max_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("ord"))).alias("embedding"))


def drop_nodes(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes named in names(label, name) and without their edges."""
    kept = nodes.join(names, ["label", "name"], "left_anti")
    a = names.select(F.col("label").alias("src_label"), F.col("name").alias("src"))
    b = names.select(F.col("label").alias("dst_label"), F.col("name").alias("dst"))
    return kept, edges.join(a, ["src_label", "src"], "left_anti").join(b, ["dst_label", "dst"], "left_anti")


def flatten_aliases(decisions: DataFrame) -> DataFrame:
    """alias, canonical, chained: chains of decisions (alias, canonical) followed to their end.

    A step doubles the reach, and closes all that are within it of their end. When a step closes none,
    those still open lead into a cycle; they are dropped. Of several decisions for an alias the
    largest name holds; stats.conflicts() reports them.
    """
    rows = cut(decisions.groupBy("alias").agg(F.max("canonical").alias("canonical")))
    keys = rows.select(F.col("alias").alias("canonical"))
    reach, left = rows, rows.join(keys, "canonical", "left_semi").count()
    while left:
        far = reach.select(F.col("alias").alias("canonical"), F.col("canonical").alias("far"))
        reach = cut(reach.join(far, "canonical", "left").select("alias", F.coalesce("far", "canonical").alias("canonical")))
        before, left = left, reach.join(keys, "canonical", "left_semi").count()
        if left == before:
            break
    first = rows.select("alias", F.col("canonical").alias("said"))
    ends = reach.join(keys, "canonical", "left_anti")
    return ends.join(first, "alias").select("alias", "canonical", (F.col("said") != F.col("canonical")).alias("chained"))


def rewrite_edges(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """edges (type, src, dst) with aliases (alias, canonical) replaced, and what became of them.

    moved counts the edges that an alias had, merged those that met an edge of the same key;
    edges that became loops are left out.
    """
    a = aliases.select(F.col("alias").alias("src"), F.col("canonical").alias("a"))
    b = aliases.select(F.col("alias").alias("dst"), F.col("canonical").alias("b"))
    out = edges.join(a, "src", "left").join(b, "dst", "left")
    out = out.withColumn("moved", F.col("a").isNotNull() | F.col("b").isNotNull())
    out = out.select("type", F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "moved")
    return out.where("NOT (moved AND src = dst)").groupBy("type", "src", "dst").agg(F.count_if("moved").alias("moved"), (F.count("*") - 1).alias("merged"))


def pending(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks (chunk_id, content_hash) that the state has not done, or has done with other text."""
    done = state.select("chunk_id", F.col("content_hash").alias("done"))
    return chunks.join(done, "chunk_id", "left").where("done IS NULL OR done != content_hash").drop("done")
