"""Counts and summaries of the stored graph and of evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nodes_by_era(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label", F.coalesce("era", F.lit("<null>")).alias("era")).agg(F.count("*").alias("n"))


def edges_by_type(edges: DataFrame) -> DataFrame:
    """Per type all edges, those without evidence, and loops."""
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.size(F.coalesce("chunk_ids", F.array().cast("array<string>"))) == 0).alias("n_bare"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops"))


def evidence_of_all(edges: DataFrame) -> DataFrame:
    """One row: all edges, those with chunks, and those that are quoted."""
    held = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return edges.agg(F.count("*").alias("n"), F.count_if(held("chunk_ids")).alias("with_chunks"), F.count_if(held("snippets")).alias("with_snippets"))


def inventory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each label and relation type: kind, name, n."""
    a = nodes.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
    b = edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n")
    return a.unionByName(b)


def conflicts(aliases: DataFrame) -> DataFrame:
    """Aliases with several canonical names of one label."""
    named = aliases.groupBy("alias", "label").agg(F.array_sort(F.collect_set("canonical")).alias("c"))
    return named.where(F.size("c") > 1).select("alias", "label", F.array_join("c", ",").alias("canonicals"))


def unique_aliases(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Aliases with one canonical name that exists with the same label."""
    one = aliases.groupBy("alias", "label").agg(F.count_distinct("canonical").alias("n"), F.max("canonical").alias("canonical")).where("n = 1")
    return one.join(nodes.select("label", F.col("name").alias("canonical")), ["label", "canonical"], "left_semi").select("alias", "label", "canonical")


def evaluation(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (status, hit, latency) per keys: all, ok, hits, accuracy over all and over answered ones."""
    answered = F.col("status").isin("ok", "no_context")
    hit = F.col("hit").cast("int")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.sum(hit).alias("hits"),
        F.round(F.avg(hit), 4).alias("accuracy"), F.round(F.avg(F.when(answered, hit)), 4).alias("accuracy_answered"),
        F.round(F.count_if(answered) / F.count("*"), 4).alias("availability"), F.round(F.avg(F.when(F.col("status") == "ok", F.col("latency"))), 4).alias("latency"),
    )


def routing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hits and totals by each key on its own, in one scan: dimension, value, hits, n."""
    dimension = F.coalesce(*[F.when(F.grouping(k) == 0, k) for k in keys])
    sets = rows.groupingSets([[k] for k in keys], *keys).agg(dimension.alias("dimension"), F.sum(F.col("hit").cast("int")).alias("hits"), F.count("*").alias("n"))
    return sets.select("dimension", F.coalesce(*keys).alias("value"), "hits", "n")


def within_budget(lines: DataFrame, key: str, order: str, line: str, budget: int) -> DataFrame:
    """Lines of each key, in order and without repeats, until one would pass the budget.

    A line costs its length and one; the first always stays, and nothing after the first that
    does not fit.
    """
    once = lines.withColumn("_r", F.row_number().over(Window.partitionBy(key, line).orderBy(order))).where("_r = 1")
    w = Window.partitionBy(key).orderBy(order)
    used = F.coalesce(F.sum(F.length(line) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = (F.row_number().over(w) > 1) & (used + F.length(line) > budget)
    out = once.withColumn("_full", full)
    broken = F.max(F.col("_full").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_full", broken).where("_full = 0").drop("_full", "_r")
