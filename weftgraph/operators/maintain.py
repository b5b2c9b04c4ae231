"""Upkeep of the stored graph: scopes, alias rules, decisions, backfills, wiping, index metadata."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.sequential import COMPOSITES, KEYWORDS
from weftgraph.functions.text import is_noise
from weftgraph.operators import align
from weftgraph.schema import ART, ART_TYPES, BOOK_ERA

# Endings and words that refer to a relative or teacher instead of naming someone.
REFERENCE_ENDINGS = (
    "父亲", "母亲", "师父", "师傅", "爹爹", "娘亲", "爸爸", "妈妈", "妻子", "丈夫", "老婆", "儿子", "女儿", "义父", "义母",
    "之父", "之母", "之妻", "之子", "之女",
)
REFERENCES = ("婴儿", "初生婴儿", "女孩儿", "男孩儿", "义父", "义母", "干爹", "干娘", "侄子", "外甥")


def scope_eras(era: str | None = None, books: list[str] | None = None) -> list[str] | None:
    """Eras of a scope: an era wins over books; what is unknown does not filter."""
    if era is not None:
        return [era]
    known = sorted({BOOK_ERA[b] for b in books or [] if b in BOOK_ERA})
    return known or None


def top_k(value: object, default: int = 5, most: int = 50) -> int:
    """A whole number from 1 to most; what is none, or below 1, is the default."""
    try:
        k = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default
    return min(k, most) if k > 0 else default


def is_reference(name: Column) -> Column:
    """Whether a name refers to someone by a relation, or is none at all, instead of naming a person."""
    words = [word for word, *_ in (*KEYWORDS, *COMPOSITES)]
    ends = name.rlike("(?:" + "|".join(REFERENCE_ENDINGS) + ")$")
    return is_noise(name) | name.contains("的") | ends | name.isin(*REFERENCES, *words)


def checked_groups(groups: dict[str, tuple[str, list[str]]], labels: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(label, alias, canonical) of merge groups; raises for unknown labels and repeated aliases."""
    rows = [(label, a, c) for c, (label, aliases) in groups.items() for a in aliases]
    seen = [(label, a) for label, a, _ in rows]
    bad = [label for label, _ in groups.values() if label not in labels]
    if bad or len(seen) != len(set(seen)) or any(a == c for _, a, c in rows):
        raise ValueError(f"labels {bad}, or repeated or own aliases")
    return rows


def match_aliases(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """nodes (label, name, era) with the canonical name that the first fitting rule gives.

    aliases has ord; a rule without eras fits all. The dictionary is a table of rules, not data,
    but it is joined by key, so its size does not matter.
    """
    rules = aliases.select(F.col("alias").alias("name"), "label", "canonical", "applicable_eras", "ord")
    met = nodes.join(rules, ["label", "name"], "left")
    fits = F.col("era").isNull() | (F.coalesce(F.size("applicable_eras"), F.lit(0)) <= 0) | F.array_contains("applicable_eras", F.col("era"))
    return met.groupBy("label", "name", "era").agg(F.min_by("canonical", F.when(fits, F.col("ord"))).alias("canonical"))


def nearest_node(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """wanted (name, era) with the label of the node of that name, one of the era if there is one."""
    met = wanted.join(nodes.select("name", "label", F.col("era").alias("node_era")), "name", "left")
    rank = F.row_number().over(Window.partitionBy("name", "era").orderBy(F.desc(F.col("node_era").eqNullSafe(F.col("era"))), "label", "node_era"))
    return met.withColumn("_r", rank).where("_r = 1").drop("_r")


def decisions(nodes: DataFrame, aliases: DataFrame, with_similar: bool = False, least: float = 0.85) -> DataFrame:
    """alias, canonical, label, source: dictionary before rules before similarity.

    A canonical name of the dictionary stays canonical whatever a later layer says.
    """
    known = match_aliases(nodes, aliases).where("canonical IS NOT NULL AND canonical != name").select("label", F.col("name").alias("alias"), "canonical", F.lit("dictionary").alias("source"), F.lit(1).alias("layer"))
    rules = align.rule_groups(nodes).select("label", "alias", "canonical", F.lit("rule").alias("source"), F.lit(2).alias("layer"))
    layers = known.unionByName(rules)
    if with_similar:
        alike = align.similar_pairs(nodes, least).select("label", F.col("b").alias("alias"), F.col("a").alias("canonical"), F.lit("similar").alias("source"), F.lit(3).alias("layer"))
        layers = layers.unionByName(alike)
    fixed = aliases.select("label", F.col("canonical").alias("alias")).distinct()
    layers = layers.where("layer = 1").unionByName(layers.where("layer > 1").join(fixed, ["label", "alias"], "left_anti"))
    first = layers.groupBy("label", "alias").agg(F.min(F.struct("layer", "canonical", "source")).alias("d"))
    return first.select("label", "alias", "d.canonical", "d.source")


def add_descendants(edges: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (type, src, dst, confidence) with the new ancestor edges as inferred ones, and the counts.

    found has ancestor, descendant and reason (null: the pair can become an edge). The counts are rows
    status, n: created, skipped (there was such an edge) and pending (there is a reason against it).
    """
    keys = ["type", "src", "dst"]
    pairs = found.select(F.lit("DESCENDANT_OF").alias("type"), F.col("ancestor").alias("src"), F.col("descendant").alias("dst"), "reason").distinct()
    judged = pairs.join(edges.select(*keys).distinct().withColumn("had", F.lit(True)), keys, "left")
    status = F.when(F.col("reason").isNotNull(), "pending").when(F.col("had"), "skipped").otherwise("created")
    judged = judged.withColumn("status", status)
    new = judged.where("status = 'created'").select(*keys, F.lit("inferred").alias("confidence"))
    return edges.unionByName(new.select(*edges.columns)), judged.groupBy("status").agg(F.count("*").alias("n"))


def ensure_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """nodes (label, name, era) and those of wanted (label, name) that were missing, of era 未知."""
    missing = wanted.select("label", "name").distinct().join(nodes, ["label", "name"], "left_anti")
    return nodes.select("label", "name", "era").unionByName(missing.withColumn("era", F.lit("未知")))


def backfill(nodes: DataFrame) -> DataFrame:
    """nodes with missing eras, books, first_seen_era and art types filled in."""
    book = F.coalesce(*[F.when(F.col("era") == e, b) for b, e in BOOK_ERA.items()])
    out = nodes.withColumn("eras", F.coalesce("eras", F.when(F.col("era").isNotNull(), F.array("era"))))
    out = out.withColumn("books", F.coalesce("books", F.when(book.isNotNull(), F.array(book))))
    out = out.withColumn("first_seen_era", F.coalesce("first_seen_era", "era"))
    return out.withColumn("art_type", F.coalesce("art_type", F.when((F.col("label") == ART) & F.col("type").isin(*ART_TYPES), F.col("type"))))


def current_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("dataset_version").isNotNull())


def wipe(spark: SparkSession, path: str, apply: bool = False, force: bool = False, thorough: bool = False) -> bool:
    """Delete a stored table; only with both flags. Without them it reports whether there is one.

    thorough deletes what lies beside it under the same name too: its index and its sidecars.
    """
    jvm = spark.sparkContext._jvm
    there = False
    for one in (path, *([f"{path}-index", f"{path}-state"] if thorough else [])):
        where = jvm.org.apache.hadoop.fs.Path(one)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.exists(where)
        there |= bool(found)
        if found and apply and force:
            fs.delete(where, True)
    return there


def save_state(path: str, state: dict) -> None:
    """Write a JSON sidecar of the driver in one step."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(state, f, ensure_ascii=False)
    os.replace(f"{path}.tmp", path)


def load_state(path: str) -> dict | None:
    """A sidecar, or None if it is missing or damaged."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def fingerprint(kind: str, model: str, dimension: int) -> str:
    return f"{kind}:{model}:{dimension}"


def check_index(meta: dict | None, kind: str, model: str, dimension: int) -> None:
    """Raises if an index was made by another embedding than the one of a query; one that does not say passes."""
    want = fingerprint(kind, model, dimension)
    if meta is not None and meta.get("fingerprint") and meta["fingerprint"] != want:
        raise ValueError(f"the index is of {meta['fingerprint']}, the query of {want}")
