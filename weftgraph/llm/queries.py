"""Queries of this subpackage, and the SQL that some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, jaccard_join, langid, lpf_dedup, lpt_shards, order_minhash, rff_quality, spaced_seeds, trigram_scan, url_markov


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edits(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigram_scan.report(_table(spark, sf_dir, "documents"))


def op3_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rff_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lpf_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judge(_table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards.shard_documents(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_order_minhash, op2_secret_scan, op3_rff_quality, op4_lpf_dedup, op5_url_markov, op6_byte_bpe, op7_spaced_seeds, op8_language_id, op9_lpt_shards, op10_jaccard_join]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": OP2_SQL, "op4_lpf_dedup": OP4_SQL, "op9_lpt_shards": OP9_SQL, "op10_jaccard_join": OP10_SQL}


def _spans_sql(kind: str, pattern: str, group: int, least: int, flags: str, order: int) -> str:
    """Spans of one kind: matches and the texts between them give the positions."""
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, '{kind}' AS kind, {order} AS ord, start_at, start_at + length(m) AS end_at
    FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g,
             unnest(list_transform(range(1, len(ms) + 1), lambda i:
               coalesce(list_sum(list_transform(between[1:i], lambda x: length(x))), 0)
               + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))) AS start_at
      FROM (
        SELECT doc_id, regexp_extract_all(t, '{p}', 0, '{flags}') AS ms,
               regexp_extract_all(t, '{p}', {group}, '{flags}') AS gs,
               regexp_split_to_array(t, '{p}', '{flags}') AS between
        FROM docs WHERE regexp_matches(t, '{p}', '{flags}')
      )
    ) WHERE length(g) >= {least}"""


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

OP2_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS (
  {_spans_sql("assign", _ASSIGN, 2, 6, "i", 1)}
  UNION ALL {_spans_sql("access", "AKIA[A-Z0-9]+", 0, 20, "c", 2)}
  UNION ALL {_spans_sql("hex", "[0-9a-f]+", 0, 24, "c", 3)}
),
per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, ord) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256
FROM docs d LEFT JOIN per_doc USING (doc_id)
"""

#: Windows of 100 bytes as 200 hexadecimal digits, named by their MD5; removed runs are islands of repeated windows.
OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100)),
f AS (SELECT k, min((doc_id, i)) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w JOIN f USING (k) WHERE (doc_id, i) > first),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 99 AS b FROM g GROUP BY 1, 2),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
t AS (SELECT doc_id, sum(b - a + 1)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS kept FROM c JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

#: CRC-32 by its table; groups above the mean load of a unit stand alone, others go to bundles by their hash; then the
#: least loaded (lowest) shard takes the largest unit, one after the other.
OP9_SQL = """
WITH RECURSIVE tab AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, sha256(unhex(sha256(coalesce(text, '')))) AS code, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, size, code, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM d),
r AS MATERIALIZED (SELECT doc_id, size, code, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b, tab),
g AS (SELECT code, sum(size) AS load FROM r GROUP BY 1),
u AS MATERIALIZED (SELECT code, load, CASE WHEN load * 8192 > (SELECT sum(load) FROM g) THEN 'g' || code ELSE 'b' || ('0x' || substr(code, 1, 8))::BIGINT % 8192 END AS unit FROM g),
o AS MATERIALIZED (SELECT unit, sum(load)::BIGINT AS load, row_number() OVER (ORDER BY sum(load) DESC, unit) AS k FROM u GROUP BY 1),
lpt AS (SELECT 0::BIGINT AS k, list_transform(range(16), lambda i: 0::BIGINT) AS loads, 0::BIGINT AS at
  UNION ALL SELECT o.k, list_transform(l.loads, lambda x, i: CASE WHEN i = list_position(l.loads, list_min(l.loads)) THEN x + o.load ELSE x END), list_position(l.loads, list_min(l.loads)) FROM lpt l JOIN o ON o.k = l.k + 1),
p AS (SELECT doc_id, size, crc, lpt.at - 1 AS shard FROM r JOIN u USING (code) JOIN o USING (unit) JOIN lpt USING (k)),
q AS (SELECT *, ('0x' || substr(sha256(concat_ws('|', doc_id, crc)), 1, 8))::BIGINT % greatest(16, (SELECT count(*) FROM r) // 50000) AS bucket FROM p)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, crc) - 1 AS slot, NULL::INT AS grown_shard FROM q
"""

OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id))::BIGINT AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) r USING (doc_id)
"""
