"""The property graph as a projection of the driver's tables, as DataFrames and as SQL.

Persons are customers and suppliers, sects nations, places regions, arts parts. The SQL is the
prefix of every oracle, so both sides state the projection once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schema import ART, PERSON, PLACE, SECT

#: Sections of the edge table that a query may ask for.
PARTS = ("BELONGS_TO", "LOCATED_IN", "FOUNDER_OF", "MASTERS", "MASTER_OF", "PARENT_OF", "SPOUSE_OF", "BRANCHED_FROM")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the session's shared one; only a local session may go without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{shared.rstrip('/')}/weft/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="weft-")


def art(key) -> F.Column:
    return F.concat(F.lit("Part#"), key.cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, name, era."""
    none = F.lit(None).cast("string").alias("era")
    t = lambda n: table(spark, sf_dir, n)
    rows = [
        t("customer").select(F.lit(PERSON).alias("label"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("era")),
        t("supplier").select(F.lit(PERSON).alias("label"), F.col("s_name").alias("name"), none),
        t("nation").select(F.lit(SECT).alias("label"), F.col("n_name").alias("name"), none),
        t("region").select(F.lit(PLACE).alias("label"), F.col("r_name").alias("name"), none),
        t("part").select(F.lit(ART).alias("label"), art(F.col("p_partkey")).alias("name"), none),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = PARTS) -> DataFrame:
    """type, src_label, src, dst_label, dst, chunk_ids of the given kinds only."""
    t = lambda n: table(spark, sf_dir, n)
    none = F.array().cast("array<string>")

    def shaped(df: DataFrame, kind: str, a: str, b: str, src, dst, ids=none) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), F.lit(a).alias("src_label"), src.alias("src"), F.lit(b).alias("dst_label"), dst.alias("dst"), ids.alias("chunk_ids"))

    orders = F.array_sort(F.collect_set(F.col("l_orderkey").cast("string")))
    customer, supplier, nation = t("customer"), t("supplier"), t("nation")
    made = {
        "BELONGS_TO": lambda: [
            shaped(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "BELONGS_TO", PERSON, SECT, F.col("c_name"), F.col("n_name")),
            shaped(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "BELONGS_TO", PERSON, SECT, F.col("s_name"), F.col("n_name")),
        ],
        "LOCATED_IN": lambda: [shaped(nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), "LOCATED_IN", SECT, PLACE, F.col("n_name"), F.col("r_name"))],
        "FOUNDER_OF": lambda: [
            shaped(supplier.groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("s_name")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")),
                   "FOUNDER_OF", PERSON, SECT, F.col("s_name"), F.col("n_name"))
        ],
        "MASTERS": lambda: [
            shaped(t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
                   .groupBy("c_name", "l_partkey").agg(orders.alias("ids")), "MASTERS", PERSON, ART, F.col("c_name"), art(F.col("l_partkey")), F.col("ids")),
            shaped(t("lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name", "l_partkey").agg(orders.alias("ids")),
                   "MASTERS", PERSON, ART, F.col("s_name"), art(F.col("l_partkey")), F.col("ids")),
        ],
        "MASTER_OF": lambda: [
            shaped(t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
                   .join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name", "c_name").agg(orders.alias("ids")),
                   "MASTER_OF", PERSON, PERSON, F.col("s_name"), F.col("c_name"), F.col("ids"))
        ],
        "PARENT_OF": lambda: [
            shaped(customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("child")).where("k > 0")
                   .join(customer.select(F.col("c_custkey").alias("p"), F.col("c_name").alias("parent")), F.expr("p = (k - 1) div 2")),
                   "PARENT_OF", PERSON, PERSON, F.col("parent"), F.col("child"))
        ],
        "SPOUSE_OF": lambda: [
            shaped(customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a"))
                   .join(customer.select(F.col("c_custkey").alias("p"), F.col("c_name").alias("b")), F.expr("p = if(k % 2 = 0, k + 1, k - 1)")),
                   "SPOUSE_OF", PERSON, PERSON, F.col("a"), F.col("b"))
        ],
        "BRANCHED_FROM": lambda: [shaped(t("part").where("p_partkey > 1"), "BRANCHED_FROM", ART, ART, art(F.col("p_partkey")), art(F.expr("p_partkey div 2")))],
    }
    rows = [df for k in kinds for df in made[k]()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, book, era, text: a document each."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.col("source"), F.lit("::"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("book"), F.col("lang").alias("era"), "text", "doc_id")


SQL = f"""
nodes AS (
  SELECT '{PERSON}' AS label, c_name AS name, c_mktsegment AS era FROM customer
  UNION ALL SELECT '{PERSON}', s_name, NULL FROM supplier
  UNION ALL SELECT '{SECT}', n_name, NULL FROM nation
  UNION ALL SELECT '{PLACE}', r_name, NULL FROM region
  UNION ALL SELECT '{ART}', 'Part#' || p_partkey, NULL FROM part
),
edges AS (
  SELECT 'BELONGS_TO' AS type, '{PERSON}' AS src_label, c_name AS src, '{SECT}' AS dst_label, n_name AS dst, []::VARCHAR[] AS chunk_ids FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'BELONGS_TO', '{PERSON}', s_name, '{SECT}', n_name, [] FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'LOCATED_IN', '{SECT}', n_name, '{PLACE}', r_name, [] FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'FOUNDER_OF', '{PERSON}', f, '{SECT}', n_name, [] FROM (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS f FROM supplier GROUP BY 1) JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'MASTERS', '{PERSON}', c_name, '{ART}', 'Part#' || l_partkey, list_sort(list(DISTINCT l_orderkey::VARCHAR))
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_name, l_partkey
  UNION ALL SELECT 'MASTERS', '{PERSON}', s_name, '{ART}', 'Part#' || l_partkey, list_sort(list(DISTINCT l_orderkey::VARCHAR))
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, l_partkey
  UNION ALL SELECT 'MASTER_OF', '{PERSON}', s_name, '{PERSON}', c_name, list_sort(list(DISTINCT l_orderkey::VARCHAR))
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, c_name
  UNION ALL SELECT 'PARENT_OF', '{PERSON}', p.c_name, '{PERSON}', c.c_name, [] FROM customer c JOIN customer p ON c.c_custkey > 0 AND p.c_custkey = (c.c_custkey - 1) // 2
  UNION ALL SELECT 'SPOUSE_OF', '{PERSON}', a.c_name, '{PERSON}', b.c_name, [] FROM customer a JOIN customer b ON b.c_custkey = CASE WHEN a.c_custkey % 2 = 0 THEN a.c_custkey + 1 ELSE a.c_custkey - 1 END
  UNION ALL SELECT 'BRANCHED_FROM', '{ART}', 'Part#' || p_partkey, '{ART}', 'Part#' || (p_partkey // 2), [] FROM part WHERE p_partkey > 1
),
chunks AS (SELECT source || '::' || doc_id AS chunk_id, source AS book, lang AS era, text, doc_id FROM documents)
"""
