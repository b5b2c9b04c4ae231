"""Vectors of texts: providers, the stored index with what it was made by, and search with a way out.

A provider is a function from a list of texts to their vectors. Without one, texts get hashed vectors
that Spark computes by itself.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import maintain, vectors

HASHED, HASH_VERSION, HASH_DIMENSION = "local-hash", "hash-v1", 256

# Names of a provider's errors that no second try mends, and the keys a text may have.
FATAL = ("AuthenticationError", "PermissionDeniedError", "BadRequestError", "NotFoundError")
TEXT_KEYS = ("text", "content", "chunk", "page_content")


class EmbeddingError(RuntimeError):
    """Vectors that a provider did not give, or gave wrongly."""


class Unavailable(RuntimeError):
    """Data that cannot be read or searched now; differs from data that is empty."""


@dataclass
class Embedder:
    """Vectors of texts from a provider, or hashed ones.

    A failing call is tried `attempts` times, unless its error's name is in FATAL. With fallback, a
    provider that fails gives way to hashed vectors for the whole of what was asked, never for a part.
    """

    call: Callable[[list[str]], list[list[float]]] | None = None
    model: str = HASH_VERSION
    dimension: int | None = None
    attempts: int = 2
    fallback: bool = False
    pause: float = 1.5
    batch: int = 64
    degraded: bool = field(default=False, init=False)
    last_error: str = field(default="", init=False)

    @property
    def kind(self) -> str:
        return "remote" if self.call else HASHED

    @property
    def spec(self) -> dict:
        size = HASH_DIMENSION if self.call is None or self.degraded else self.dimension or 0
        kind, model = (HASHED, HASH_VERSION) if self.call is None or self.degraded else (self.kind, self.model)
        return {"kind": kind, "model": model, "dimension": size, "fingerprint": f"{kind}:{model}:{size}"}

    def query(self, text: str, spark: SparkSession) -> list[float]:
        """The vector of one text, on the driver."""
        rows = self.embed(spark.createDataFrame([(0, text)], "id int, text string"), "id", "text").collect()
        return list(rows[0]["embedding"])

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """key, embedding (array of double) of rows; equal texts are asked for once."""
        self.degraded, self.last_error = False, ""
        if self.call is None:
            return hash_vectors(rows, key, text)
        said = rows.select(key, F.coalesce(text, F.lit("")).alias("_t")).withColumn("_h", F.sha2("_t", 256))
        once = said.groupBy("_h").agg(F.first("_t").alias("_t"))
        call, attempts, pause, size, batch = self.call, max(1, min(5, self.attempts)), self.pause, self.dimension, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch]
                    yield pd.DataFrame({"_h": part["_h"], "embedding": checked(asked(call, part["_t"].tolist(), attempts, pause), len(part), size)})

        try:
            found = vectors.cut(once.mapInPandas(run, "_h string, embedding array<double>"))
            sizes = [r[0] for r in found.select(F.size("embedding")).distinct().limit(2).collect()]
            if len(sizes) > 1:
                raise EmbeddingError(f"vectors of {sizes[0]} and of {sizes[1]} numbers")
        except (PySparkException, EmbeddingError) as e:
            self.last_error = str(e).splitlines()[0][:300] if str(e) else type(e).__name__
            if not self.fallback:
                raise EmbeddingError(self.last_error) from e
            if self.dimension not in (None, HASH_DIMENSION):
                raise EmbeddingError(f"hashed vectors have {HASH_DIMENSION} numbers, the index {self.dimension}") from e
            self.degraded = True
            return hash_vectors(rows, key, text)
        self.dimension = self.dimension or (sizes[0] if sizes else None)
        return said.join(found, "_h").select(key, "embedding")


def asked(call: Callable[[list[str]], list[list[float]]], texts: list[str], attempts: int, pause: float = 0.0) -> list[list[float]]:
    """A provider's answer, after as many attempts as its errors allow."""
    for attempt in range(1, attempts + 1):
        try:
            return [list(v) for v in call(texts)]
        except Exception as e:  # a provider's errors are its own
            if type(e).__name__ in FATAL or attempt == attempts:
                raise EmbeddingError(f"{type(e).__name__}: {e}") from e
            time.sleep(min(pause * attempt, 4))
    return []


def checked(found: list[list[float]], n: int, size: int | None) -> list[list[float]]:
    """Vectors as they are; raises for a wrong number of them, numbers that are none, and sizes that differ."""
    sizes = {len(v) for v in found} | ({size} if size else set())
    if len(found) != n or len(sizes) > 1 or 0 in sizes:
        raise EmbeddingError(f"{len(found)} vectors of sizes {sorted(sizes)} for {n} texts")
    if not all(isinstance(x, int | float) and math.isfinite(x) for v in found for x in v):
        raise EmbeddingError("vectors with numbers that are not finite")
    return found


def hash_vectors(rows: DataFrame, key: str, text: str, dim: int = HASH_DIMENSION) -> DataFrame:
    """key, embedding: vectors.hash_embedding() as arrays, zeros for texts without tokens."""
    sparse = vectors.hash_embedding(rows, key, text, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("m"))
    held = rows.select(key).join(sparse, key, "left")
    slots = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
    return held.select(key, F.transform(slots, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def text_of(rows: DataFrame) -> Column:
    """The first text of a row that is not blank, by the names it may have."""
    said = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in TEXT_KEYS if c in rows.columns]
    return F.coalesce(*said, F.lit(""))


def build_index(chunks: DataFrame, embedder: Embedder, path: str) -> dict:
    """Store the vectors of chunks (chunk_id, text, and book, era, chapter if there) and what made them."""
    kept = [c for c in ("chunk_id", "text", "book", "era", "chapter") if c in chunks.columns]
    made = embedder.embed(chunks.withColumn("text", text_of(chunks)), "chunk_id", "text")
    chunks.select(*kept).join(made, "chunk_id").write.mode("overwrite").parquet(f"{path}/vectors")
    meta = embedder.spec
    meta_row = chunks.sparkSession.createDataFrame([tuple(meta.values())], "kind string, model string, dimension int, fingerprint string")
    meta_row.withColumn("updated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return meta


def read_meta(spark: SparkSession, path: str) -> dict | None:
    """What an index was made by, or None if it does not say."""
    try:
        row = spark.read.schema("kind string, model string, dimension int, fingerprint string, updated_at string").json(f"{path}/meta").first()
    except PySparkException:
        return None
    return row.asDict() if row else None


def search(spark: SparkSession, path: str, question: str, embedder: Embedder, k: object = 5, era: str | None = None, prefilter: bool = False) -> DataFrame:
    """The k chunks of an index most like a question: chunk_id, text, book, era, chapter, score.

    The question is embedded first and has to fit what made the index. An era filters the k found, so
    fewer may be left; with prefilter it is applied before.
    """
    limit = maintain.top_k(k)
    asked_for = embedder.query(question, spark)
    meta = read_meta(spark, path)
    try:
        maintain.check_index(meta, embedder.spec["kind"], embedder.spec["model"], embedder.spec["dimension"])
        rows = spark.read.parquet(f"{path}/vectors")
    except (ValueError, PySparkException) as e:
        raise Unavailable(str(e).splitlines()[0]) from e
    if meta and meta["dimension"] and len(asked_for) != meta["dimension"]:
        raise Unavailable(f"the question has {len(asked_for)} numbers, the index {meta['dimension']}")
    inside = F.col("era").isNull() | F.col("era").isin("", era) if era and "era" in rows.columns else F.lit(True)
    found = vectors.top_k(rows.where(inside) if prefilter else rows, asked_for, limit, "chunk_id")
    return (found if prefilter else found.where(inside)).drop("embedding")


def search_chunks(chunks: DataFrame, question: str, embedder: Embedder, k: int = 5) -> DataFrame:
    """The k chunks most like a question, all of them embedded now."""
    if k <= 0:
        return chunks.select("chunk_id", text_of(chunks).alias("text"), F.lit(0.0).alias("score")).limit(0)
    asked_for = embedder.query(question, chunks.sparkSession)
    rows = chunks.select("chunk_id", text_of(chunks).alias("text"))
    return vectors.top_k(rows.join(embedder.embed(rows, "chunk_id", "text"), "chunk_id"), asked_for, k, "chunk_id")


def embed_and_search(spark: SparkSession, path: str | None, question: str, embedder: Embedder, chunks: DataFrame | None = None, k: int = 5) -> tuple[DataFrame, str]:
    """search(), or search_chunks() where the index is not to be used; and why that was, else an empty text."""
    if path is not None:
        try:
            return search(spark, path, question, embedder, k), ""
        except (Unavailable, EmbeddingError) as e:
            reason = f"{type(e).__name__}: {e}"
            if chunks is None:
                raise Unavailable(reason) from e
            return search_chunks(chunks, question, embedder, k), reason
    if chunks is None:
        raise Unavailable("neither an index nor chunks")
    return search_chunks(chunks, question, embedder, k), ""
