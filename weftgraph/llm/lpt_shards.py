"""Sharding by longest-processing-time scheduling.

Groups that must stay together go, from the largest to the smallest, to the shard with the
least load, taken from a heap. The number of groups grows with the corpus, so the heap does not
see every one of them: a group above the mean load of a unit (total / (shards * grain)) is a
unit of its own, of which there are at most shards * grain, and the smaller ones are first laid
by a hash of their key into shards * grain bundles. The driver thus schedules at most
2 * shards * grain units, whatever the input's size, and no unit splits a group. With fewer
groups than bundles nearly every group is a unit of its own.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import id_and_text, stash

#: Scheduled units of each kind for a shard; bounds what reaches the driver.
GRAIN = 512

#: Rows whose slots are numbered in one task, on average.
SLOT_ROWS = 50_000


def schedule(sizes: dict[str, int], shards: int) -> dict[str, int]:
    """Units to shards: largest first (ties by name), each to the least loaded (lowest) shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for unit, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def _number(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def assign(rows: DataFrame, key: str, size: str, shards: int = 16, grain: int = GRAIN) -> DataFrame:
    """rows with a column shard; rows of equal key share one.

    Null keys are a group like any other, a null size counts 0,
    an empty table gives none. rows is read three times; pass a table that is cheap to read.
    """
    spark, units = rows.sparkSession, shards * grain
    code = F.coalesce(F.sha2(F.col(key) if dict(rows.dtypes)[key] == "binary" else F.col(key).cast("string"), 256), F.lit(""))
    groups = rows.groupBy(key).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("_load"))
    groups = stash(groups, "groups")
    total = groups.agg(F.sum("_load")).first()[0] or 0
    own = F.col("_load") * units > total
    bundle = F.concat(F.lit("b"), F.coalesce(_number(code) % units, F.lit(0)).cast("string"))
    large = groups.where(own).withColumn("_unit", F.concat(F.lit("g"), code))
    loads = large.select("_unit", "_load").unionByName(groups.where(~own).select(bundle.alias("_unit"), "_load"))
    # At most 2 * units rows.
    plan = schedule({u: int(n) for u, n in loads.groupBy("_unit").agg(F.sum("_load")).collect()}, shards)
    table = spark.createDataFrame(list(plan.items()), "_unit string, shard int")
    named = large.select(F.col(key).alias("_key"), F.col("_unit").alias("_own"))  # at most units rows
    out = rows.join(F.broadcast(named), F.col(key).eqNullSafe(F.col("_key")), "left")
    out = out.withColumn("_unit", F.coalesce("_own", bundle))
    return out.join(F.broadcast(table), "_unit", "left").drop("_unit", "_own", "_key")


def slots(rows: DataFrame, order: list[str], count: int, per_task: int = SLOT_ROWS) -> DataFrame:
    """rows with slot: a gapless number from 0 within each shard.

    Rows are dealt over buckets by a hash of the order columns and numbered within a bucket;
    a bucket begins where the shard's buckets before it end. Ties get numbers of their own.
    """
    buckets = max(16, count // per_task)
    rows = rows.withColumn("_bucket", _number(F.sha2(F.concat_ws("|", *order), 256)) % buckets)
    sums = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = rows.groupBy("shard", "_bucket").count().withColumn("_from", F.coalesce(F.sum("count").over(sums), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*order)) - 1
    out = rows.withColumn("_slot", number).join(begin.drop("count"), ["shard", "_bucket"])
    return out.withColumn("slot", (F.col("_from") + F.col("_slot")).cast("long")).drop("_bucket", "_slot", "_from")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Law bytes: the shards' sizes are near equal. Documents of equal text stay together; a null
    text is an empty one, and texts are read whole, whatever their length. Repeated rows and ties
    are documents of their own, with slots of their own; a null doc_id is carried through. Other
    columns are ignored; no rows give no rows.
    """
    text = id_and_text(docs)
    rows = text.select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("_text"),
    )
    rows = stash(rows, "sizes")
    count = rows.count()
    placed = slots(assign(rows, "_text", "size", shards), ["doc_id", "text_crc32"], count)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
