"""What ingestion knows of itself: settings, manifests, checkpoints, logs, and versions of the stored graph.

Sidecars are single rows of JSON, written where the data is by Spark, so they work in any store.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import extract
from weftgraph.sources.files import DataError

_YES, _NO = ("1", "true", "yes", "on", "y"), ("0", "false", "no", "off", "n", "")
PREFIX = "WEFTGRAPH_"


def get_int(key: str, default: int, least: int | None = None, most: int | None = None, env: Mapping[str, str] | None = None) -> int:
    """A whole number of the environment within its limits; what is none is the default."""
    try:
        value = int(((os.environ if env is None else env).get(PREFIX + key) or "").strip() or default)
    except ValueError:
        value = default
    value = value if least is None else max(least, value)
    return value if most is None else min(most, value)


def get_bool(key: str, default: bool = False, env: Mapping[str, str] | None = None) -> bool:
    said = (os.environ if env is None else env).get(PREFIX + key)
    said = None if said is None else said.strip().lower()
    return True if said in _YES else False if said in _NO else default


@dataclass(frozen=True)
class Settings:
    """One reading of the configuration."""

    top_k: int
    budget: int
    chunk_size: int
    overlap: int
    attempts: int
    embed_dimension: int
    embed_fallback: bool

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        return cls(
            get_int("TOP_K", 5, 1, 50, env), get_int("BUDGET", 6000, 500, 100_000, env), get_int("CHUNK_SIZE", 1500, 1, None, env), get_int("OVERLAP", 200, 0, None, env),
            get_int("ATTEMPTS", 4, 1, 10, env), get_int("EMBED_DIMENSION", 0, 0, None, env), get_bool("EMBED_FALLBACK", False, env),
        )

    def problems(self) -> list[str]:
        return ["the overlap has to be smaller than a chunk"] if self.overlap >= self.chunk_size else []


# Sidecars


def write_sidecar(spark: SparkSession, path: str, state: dict) -> None:
    spark.createDataFrame([(json.dumps(state, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_sidecar(spark: SparkSession, path: str) -> dict | list | None:
    """A sidecar, or None if it is missing or damaged."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
        return json.loads(rows[0]["value"]) if rows else None
    except (PySparkException, ValueError):
        return None


def now(spark: SparkSession) -> str:
    """The time as ISO text with its offset."""
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).first()[0]


def write_manifest(chunks: DataFrame, path: str, version: str, **sections: dict) -> dict:
    """Store, beside the chunks, of each book its era, chunks and characters, with the data's version and more sections."""
    counts = chunks.groupBy("book").agg(F.min("era").alias("era"), F.count("*").alias("chunk_count"), F.sum(F.length("text")).alias("total_chars"))
    books = {r["book"]: {"era": r["era"], "chunk_count": r["chunk_count"], "total_chars": r["total_chars"]} for r in counts.collect()}  # a row for each book
    state = {"dataset_version": version, "books": books, "generated_at": now(chunks.sparkSession), **sections}
    write_sidecar(chunks.sparkSession, path, state)
    return state


def update_manifest(spark: SparkSession, path: str, **sections: object) -> dict | None:
    """Merge sections into a stored manifest, dictionaries key by key; None if there is no manifest."""
    state = read_sidecar(spark, path)
    if not isinstance(state, dict):
        return None
    for key, value in sections.items():
        state[key] = (state.get(key) or {}) | value if isinstance(value, dict) else value
    write_sidecar(spark, path, state)
    return state


# Checkpoints of extraction

FORMAT = "weft-state-1"


class Incompatible(DataError):
    """A checkpoint of other data than what is to be ingested."""


@dataclass(frozen=True)
class Signature:
    """What a checkpoint belongs to; an empty field is not compared."""

    book: str = ""
    dataset_version: str = ""
    source_sha256: str = ""


def write_checkpoint(done: DataFrame, path: str, signature: Signature) -> None:
    """Store done (chunk_id, content_hash, status, error) with what it belongs to."""
    done.select("chunk_id", "content_hash", "status", F.substring("error", 1, 500).alias("error")).write.mode("overwrite").parquet(f"{path}/chunks")
    write_sidecar(done.sparkSession, f"{path}/signature", {"format": FORMAT, **vars(signature), "updated_at": now(done.sparkSession)})


def read_checkpoint(spark: SparkSession, path: str, signature: Signature) -> DataFrame | None:
    """The chunks of a checkpoint, None if there is none; raises Incompatible for one of another format, version or source."""
    said = read_sidecar(spark, f"{path}/signature")
    if said is None:
        try:
            spark.read.parquet(f"{path}/chunks")
        except PySparkException:
            return None
        raise Incompatible("the checkpoint does not say what it belongs to")
    if not isinstance(said, dict) or said.get("format") != FORMAT:
        raise Incompatible("the checkpoint is of an older format")
    for key in ("dataset_version", "source_sha256"):
        want = getattr(signature, key)
        if want and said.get(key) and said[key] != want:
            raise Incompatible(f"{key}: {said[key]} instead of {want}")
    return spark.read.parquet(f"{path}/chunks")


def to_do(chunks: DataFrame, checkpoint: DataFrame | None) -> DataFrame:
    """Chunks (chunk_id, content_hash, ...) that are not done, or were done with another text, or failed."""
    if checkpoint is None:
        return chunks
    done = checkpoint.where(F.col("status").isin("ok", "empty")).select("chunk_id", F.col("content_hash").alias("_done"))
    kept = chunks.join(done, "chunk_id", "left")
    return kept.where("_done IS NULL OR (_done != '' AND content_hash != '' AND _done != content_hash)").drop("_done")


# Logs


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines."""
    rows.write.mode("append").json(path)


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """id of every line of a log that is JSON and has one, once; none if there is no log."""
    try:
        lines = spark.read.text(path)
    except PySparkException:
        return spark.createDataFrame([], "id string")
    return lines.select(F.get_json_object("value", "$.id").alias("id")).where("id IS NOT NULL").distinct()


def reparse(log: DataFrame, examples: int = 5) -> DataFrame:
    """One row of figures of a log (chunk_id, text, era, raw) that is parsed again, without asking anyone.

    records, reparsed, still_invalid, entities, relationships, rejected, and the first chunk_ids that are invalid.
    """
    parsed = extract.parse(log.withColumn("answer", F.col("raw")))
    good = F.col("status") != "retryable"
    clean = extract.entities(parsed)
    accepted, judged = extract.relations(parsed, clean)
    bad = parsed.where(~good).select("chunk_id").orderBy("chunk_id").limit(examples).agg(F.array_sort(F.collect_list("chunk_id")).alias("v"))
    counts = [
        parsed.agg(F.count("*").alias("n")).select(F.lit("records").alias("name"), "n"), parsed.where(good).agg(F.count("*").alias("n")).select(F.lit("reparsed").alias("name"), "n"),
        parsed.where(~good).agg(F.count("*").alias("n")).select(F.lit("still_invalid").alias("name"), "n"), clean.agg(F.count("*").alias("n")).select(F.lit("entities").alias("name"), "n"),
        accepted.agg(F.count("*").alias("n")).select(F.lit("relationships").alias("name"), "n"),
        judged.where("reason IS NOT NULL").agg(F.count("*").alias("n")).select(F.lit("rejected").alias("name"), "n"),
    ]
    none = F.array().cast("array<string>")
    rows = bad.select(F.lit("examples").alias("name"), F.size("v").cast("long").alias("n"), F.col("v").alias("examples"))
    for c in counts:
        rows = rows.unionByName(c.select("name", "n", none.alias("examples")))
    return rows


# Versions of the stored graph

TABLES = ("chunks", "nodes", "edges", "mentions")


def checked(df: DataFrame, schema: dict[str, str], key: list[str] | None = None) -> DataFrame:
    """df if it has the columns of a schema in their types, and its keys once and without nulls; raises DataError else."""
    kinds = dict(df.dtypes)
    wrong = [f"{c}: {kinds.get(c, 'missing')} instead of {t}" for c, t in schema.items() if kinds.get(c) != t]
    if wrong:
        raise DataError("; ".join(wrong))
    if key:
        n, bad = df.agg(F.count("*"), F.count_if(F.greatest(*[F.col(k).isNull() for k in key], F.lit(False)))).first()
        repeated = df.groupBy(*key).count().where("count > 1").limit(1).count()
        if bad or repeated:
            raise DataError(f"{bad} of {n} rows without {key}" if bad else f"repeated {key}")
    return df


def checked_vectors(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """df if all its vectors that are there have that many numbers; raises DataError else."""
    other = df.where(F.col(vector).isNotNull() & (F.size(vector) != dimension)).limit(1).count()
    if other:
        raise DataError(f"vectors that have not {dimension} numbers")
    return df


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> int:
    """Write tables as the next version, all of them or none: readers see it once its number is written last."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise DataError(f"unknown tables {sorted(unknown)}")
    last = current(spark, path)
    n = 0 if last is None else last["version"] + 1
    kept = {} if last is None else last["tables"]
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/v{n}")
    write_sidecar(spark, f"{path}/current", {"version": n, "tables": kept | {name: n for name in tables}})
    return n


def current(spark: SparkSession, path: str) -> dict | None:
    """The last committed version, and of each table the version that holds it."""
    state = read_sidecar(spark, f"{path}/current")
    return state if isinstance(state, dict) else None


def read_version(spark: SparkSession, path: str, name: str) -> DataFrame:
    state = current(spark, path)
    if state is None or name not in state["tables"]:
        raise DataError(f"no table {name} in {path}")
    return spark.read.parquet(f"{path}/{name}/v{state['tables'][name]}")


def save_aliases(aliases: DataFrame, path: str) -> None:
    """Store an alias dictionary as JSON lines."""
    aliases.write.mode("overwrite").json(path)


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """A stored alias dictionary; an empty one if it is missing."""
    from weftgraph.schema import ALIAS

    try:
        return spark.read.schema(ALIAS).json(path)
    except PySparkException:
        return spark.createDataFrame([], ALIAS)
