"""Vector and full-text search, hashed embeddings."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import tokens
from weftgraph.operators.graph import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for empty ones, unequal lengths and zero vectors."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def valid_vector(v: Column, dim: int) -> Column:
    """Whether a vector has dim finite numbers."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite, F.lit(False))


def top_k(rows: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows most like the query by cosine, then by key; none for k below 1."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(key, *[c for c in rows.columns if c not in (key, vector)], F.round(cosine(F.col(vector), q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(max(k, 0))


def hash_embedding(rows: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """key, slot, weight: signed counts of hashed tokens, divided by their norm."""
    token = rows.select(key, F.explode(tokens(F.col(text))).alias("token"))
    digest = F.sha2("token", 256)
    slot = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dim))
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = token.select(key, slot.alias("slot"), sign.alias("sign")).groupBy(key, "slot").agg(F.sum("sign").alias("sum")).where("sum != 0")
    norm = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("sum") * F.col("sum")).cast("double")).alias("norm"))
    return sums.join(norm, key).select(key, "slot", F.round(F.col("sum") / F.col("norm"), 6).alias("weight"))


def _equal(array: str, value: str) -> Column:
    return F.filter(array, lambda x: x == value)


def bm25(rows: DataFrame, key: str, text: str, query: list[str], k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k rows that match the query's tokens best; no tokens match nothing.

    A text is tokenised once: its length and how often it has each token of the query are kept, of
    which then the statistics and the scores come. text_index() keeps these for all tokens.
    """
    query = list(dict.fromkeys(query))
    split = rows.select(key, tokens(F.col(text)).alias("t"))
    has = [F.array_size(_equal("t", q)).alias(f"tf{i}") for i, q in enumerate(query)]
    counted = cut(split.select(key, F.array_size("t").alias("size"), *has))
    n, mean, *found = counted.agg(F.count("*"), F.avg("size"), *[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(query))]).first()
    weights = [F.lit(0.0)]
    for i, df in enumerate(found):
        tf = F.col(f"tf{i}")
        weights.append(F.lit(log(1 + (n - df + 0.5) / (df + 0.5))) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / (mean or 1.0))))
    some = reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(query))], F.lit(False))
    return counted.where(some).select(key, F.round(reduce(lambda x, y: x + y, weights), 4).alias("score")).orderBy(F.desc("score"), key).limit(k)


def text_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The inverted table of a text column: token, key, tf, size; stored by token, a question reads its tokens alone."""
    split = rows.select(key, tokens(F.col(text)).alias("t"))
    return split.select(key, F.array_size("t").alias("size"), F.explode("t").alias("token")).groupBy("token", key, "size").agg(F.count("*").alias("tf"))


def search_index(index: DataFrame, key: str, query: list[str], n: int, mean: float, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """bm25() on a text_index() of n rows of that mean length."""
    hits = index.where(F.col("token").isin(*query))
    found = hits.groupBy("token").agg(F.count("*").alias("df"))  # a row for each token of the query
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / (mean or 1.0)))
    return hits.join(F.broadcast(found), "token").groupBy(key).agg(F.round(F.sum(weight), 4).alias("score")).orderBy(F.desc("score"), key).limit(k)
