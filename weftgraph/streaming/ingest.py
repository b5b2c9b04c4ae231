"""Incremental ingestion: files that arrive are merged into a table once, however often it runs; windows of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.sources.files import DataError
from weftgraph.sources.state import read_sidecar, write_sidecar

#: Parts of a merged table; a batch writes those anew that it has keys of.
BUCKETS = 64


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def _state(spark: SparkSession, target: str) -> dict | None:
    """The last batch that was merged, the number of buckets, and the batch that wrote each."""
    state = read_sidecar(spark, f"{target}/current")
    return state if isinstance(state, dict) else None


def _buckets(spark: SparkSession, target: str, schema: StructType, state: dict, wanted: list[int] | None = None) -> DataFrame:
    """Rows of the wanted buckets (of all by default) with _bucket; folders of others are not read."""
    by_version: dict[int, list[int]] = {}
    for bucket, version in state["versions"].items():
        if wanted is None or int(bucket) in wanted:
            by_version.setdefault(version, []).append(int(bucket))
    parts = [spark.read.schema(schema).parquet(*[f"{target}/v{v}/_bucket={b}" for b in sorted(found)]) for v, found in sorted(by_version.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def merged(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The table as the last complete batch left it."""
    state = _state(spark, target)
    return spark.createDataFrame([], schema) if state is None else _buckets(spark, target, schema, state)


def upsert(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str, order: list[str], buckets: int = BUCKETS) -> int:
    """Merge the Parquet files of a folder that were not merged before; returns the batches run.

    Rows lie in buckets by their key. A batch writes the buckets that it has keys of beside the old
    ones, and then says which batch wrote each; readers see either all of a batch or nothing. A batch
    that is repeated after a failure does the same again, or nothing if it was done. One whose
    predecessor was not merged raises, as it would lose what that had.
    """
    done = []

    def merge(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        state = _state(session, target)
        if state is not None and state["batch"] >= n:
            return
        if (state is None and n > 0) or (state is not None and state["batch"] != n - 1):
            raise DataError(f"batch {n} follows {'nothing' if state is None else state['batch']} in {target}")
        state = state or {"batch": -1, "buckets": buckets, "versions": {}}
        bucket = F.pmod(F.xxhash64(key), F.lit(state["buckets"])).cast("int")
        new = batch.persist()
        touched = [r["b"] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` rows
        rows = latest(_buckets(session, target, schema, state, touched).unionByName(new.select(*schema.names)), key, order)
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/v{n}")
        new.unpersist()
        versions = state["versions"] | {str(b): n for b in touched}
        write_sidecar(session, f"{target}/current", {"batch": n, "buckets": state["buckets"], "versions": versions})
        _remove(session, target, n, {*versions.values(), *state["versions"].values()})
        done.append(n)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def _remove(spark: SparkSession, target: str, n: int, used: set[int]) -> None:
    """Delete the batches that neither the table nor its last state before uses."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(target)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) < n and int(name[1:]) not in used:
            fs.delete(status.getPath(), True)


def _timed(events: DataFrame, late: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events per type and window, on a stream or a table; ts becomes a timestamp.

    Windows tumble, or with slide begin so often and overlap. On a stream, events that come later than
    `late` after the newest one are left out.
    """
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _timed(events, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", key: str = "user_id") -> DataFrame:
    """Sessions of each key, which end where no event follows within the gap: begin, end, n."""
    window = F.session_window("ts", gap)
    return _timed(events, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")
