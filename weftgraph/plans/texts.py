"""Queries about names, eras, books, vectors and what is written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import sequential, text
from weftgraph.operators import align, answer, graph, linking, maintain, match, retrieval, service, stats, vectors
from weftgraph.plans.projection import chunks, edges, nodes, shared_folder, table
from weftgraph.plans.registry import query
from weftgraph.schema import PERSON
from weftgraph.service_http import with_edge_ids
from weftgraph.sources import files

_CUSTOMER = "c_custkey AS id, c_custkey % 6 AS k, c_name"


def _formed(spark, d, forms: tuple[str, ...]):
    """id and text of each customer: one of the forms, with the customer's name in the place of %s."""
    c = table(spark, d, "customer")
    said = F.get(F.array(*map(F.lit, forms)), (F.col("c_custkey") % len(forms)).cast("int"))
    return c.select(F.col("c_custkey").alias("id"), F.replace(said, F.lit("%s"), F.col("c_name")).alias("text"))


# Names and eras


@query(f"SELECT id, k IN (0, 1, 4) AS designation FROM (SELECT {_CUSTOMER} FROM customer)", False)
def designations(spark, d):
    return _formed(spark, d, ("%s的父亲", "%s与乙", "%s", "甲和乙", "%s跟", "杨过之女")).select("id", text.is_designation(F.col("text")).alias("designation"))


@query(f"SELECT id, CASE k WHEN 0 THEN c_name WHEN 1 THEN '欧阳锋' WHEN 2 THEN '大侠' WHEN 3 THEN c_name WHEN 4 THEN '慕容复' ELSE '令狐冲' END AS name FROM (SELECT {_CUSTOMER} FROM customer)", False)
def names_normalized(spark, d):
    return _formed(spark, d, ("%s大侠", "欧阳氏锋前辈", "大侠", "%s", "慕容氏复", "令狐氏冲阁下")).select("id", text.normal_name(F.col("text")).alias("name"))


@query(f"SELECT id, CASE k WHEN 0 THEN '射雕' WHEN 1 THEN '射雕,神雕' WHEN 2 THEN '倚天' WHEN 3 THEN '神雕' ELSE '' END AS eras FROM (SELECT {_CUSTOMER} FROM customer)", False)
def eras_of_questions(spark, d):
    q = _formed(spark, d, ("射雕英雄传里%s是谁", "南宋时%s是谁", "元末的%s", "神雕侠侣里的%s", "%s是谁", "%s"))
    return q.select("id", F.array_join(text.era_scope(F.col("text")), ",").alias("eras"))


@query(f"SELECT id, CASE k WHEN 0 THEN '射雕' WHEN 1 THEN '神雕' WHEN 2 THEN '倚天' WHEN 3 THEN '神雕' END AS era FROM (SELECT {_CUSTOMER} FROM customer)", False)
def eras_normalized(spark, d):
    return _formed(spark, d, (" 射雕 ", "神雕侠侣", "新版倚天屠龙记", "神雕", "%s", "")).select("id", text.known_era(F.col("text")).alias("era"))


@query(f"SELECT id, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 1 END::INT AS hops FROM (SELECT {_CUSTOMER} FROM customer)", False)
def chain_lengths(spark, d):
    q = _formed(spark, d, ("%s的徒弟", "%s的师祖", "%s的师父的师傅", "%s的太师父", "%s的师父的师父的师父的师父的师父", "%s"))
    return q.select("id", answer.chain_length(F.col("text")).alias("hops"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'self' WHEN c_custkey % 3 = 1 THEN 'no_ancestor' WHEN c_custkey % 9 = 8 THEN 'no_descendant' END AS reason FROM customer""", False)
def ancestors_known(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 3
    found = c.select(F.col("c_custkey").alias("id"), F.when(k == 1, "nobody").otherwise(F.col("c_name")).alias("ancestor"), F.when(k == 0, F.col("c_name")).when(F.col("c_custkey") % 9 == 8, "no one").otherwise("x").alias("descendant"))
    names = c.select(F.col("c_name").alias("name")).unionByName(spark.createDataFrame([("x",)], "name string"))
    return align.known_ancestors(found, names).select("id", "reason")


@query("SELECT n_name AS name, 0::INT AS n_chunks FROM nation WHERE n_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier))", False)
def method_sects_founded(spark, d):
    first = table(spark, d, "supplier").agg(F.min_by("s_name", "s_suppkey")).first()[0]
    return answer.sect_agg(edges(spark, d, ("FOUNDER_OF",)), first, "founded", 50)


@query(f"SELECT name, label, era FROM nodes WHERE era IN ('BUILDING', 'MACHINERY') AND label = '{PERSON}'")
def nodes_in_scope(spark, d):
    return match.scoped_nodes(nodes(spark, d), maintain.scope_eras("BUILDING") + ["MACHINERY"], (PERSON,))


@query("SELECT src || '|' || type || '|' || dst AS id, dst FROM edges WHERE type IN ('LOCATED_IN', 'SPOUSE_OF')")
def edge_ids(spark, d):
    return with_edge_ids(edges(spark, d, ("LOCATED_IN", "SPOUSE_OF"))).select("id", "dst")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE len(chunk_ids) > 0) AS with_chunks, count(*) FILTER (WHERE type = 'SPOUSE_OF') AS with_snippets FROM edges WHERE type IN ('MASTER_OF', 'SPOUSE_OF')")
def edges_with_evidence(spark, d):
    e = edges(spark, d, ("MASTER_OF", "SPOUSE_OF"))
    return stats.evidence_of_all(e.withColumn("snippets", F.when(F.col("type") == "SPOUSE_OF", F.array(F.lit("x")))))


@query("SELECT id, k IN (0, 2, 3) AS valid FROM (SELECT c_custkey AS id, c_custkey % 4 AS k FROM customer)", False)
def paths_valid(spark, d):
    k = F.col("c_custkey") % 4
    step = lambda a, b: F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"))
    none = F.array().cast("array<struct<source:string,target:string>>")
    path = F.when(k == 0, F.array(step("a", "b"), step("b", "c"))).when(k == 1, F.array(step("a", "b"), step("c", "d"))).when(k == 2, F.array(step("a", "b"))).otherwise(none)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), answer.path_valid(path).alias("valid"))


@query("SELECT unnest(['art_lineage', 'chunk_graph', 'cross_novel', 'fulltext', 'master_chain', 'person_relation', 'sect_agg', 'vector']) AS method, unnest(['path', 'text', 'path', 'text', 'path', 'triples', 'subgraph', 'text']) AS injection", False)
def methods_registered(spark, d):
    rows = spark.createDataFrame([(m,) for m in sorted(answer.METHODS)], "method string")
    return rows.select("method", linking.injection_name(F.col("method")).alias("injection"))


@query(r"""WITH p AS (SELECT DISTINCT e.src AS a, e.dst AS b FROM edges e WHERE type = 'PARENT_OF' AND (src IN ('Customer#000000001', 'Customer#000000002', 'Customer#000000004') AND dst IN ('Customer#000000001', 'Customer#000000002', 'Customer#000000004')))
SELECT a AS source, b AS name, 1::INT AS distance, true AS blood FROM p""")
def cross_pairs_of_persons(spark, d):
    """Customers 1, 4 (a child of 1) and 2: those joined by one edge."""
    e = edges(spark, d, ("PARENT_OF",))
    kin = e.withColumn("type", F.lit("DESCENDANT_OF"))
    return answer.cross_pairs(kin, ["Customer#000000001", "Customer#000000002", "Customer#000000004"], 5, 1).select("source", "name", "distance", "blood")


@query(r"""WITH a AS (SELECT src, dst FROM edges WHERE type = 'PARENT_OF'), s AS (SELECT 'Customer#000000001' AS n) SELECT 2::INT AS depth, n || ',' || x.dst || ',' || y.dst AS names, 2::INT AS n_rels FROM s JOIN a x ON x.src = n JOIN a y ON y.src = x.dst ORDER BY 2 LIMIT 5""")
def chains_with_edges(spark, d):
    found = answer.master_chain(edges(spark, d, ("PARENT_OF",)), "Customer#000000001", 2, "out", 5, "PARENT_OF")
    return found.select("depth", F.array_join("names", ",").alias("names"), F.size("rels").alias("n_rels"))


# Books and texts


@query(r"""WITH l AS (SELECT doc_id, array_to_string(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), chr(10)) AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS hash FROM l""", False)
def texts_decoded(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.concat(F.lit("  "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" \r\n"))).cast("binary").alias("raw"))
    return raw.select("doc_id", F.sha2(files.decoded(F.col("raw")), 256).alias("hash"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM documents)
SELECT doc_id, unnest(['开篇', '第一回 起', '第二回 承']) AS chapter, unnest([2, length(t), 1 + length(t)])::INT AS n FROM t WHERE t <> '' UNION ALL SELECT doc_id, unnest(['开篇', '第二回 承']), unnest([2, 1]) FROM t WHERE t = ''""", False)
def chapters_split(spark, d):
    body = F.coalesce("text", F.lit(""))
    book = F.concat(F.lit("序言\n第一回 起\n"), body, F.lit("\n 　第二回 承 \n"), F.lit("终"), body)
    found = table(spark, d, "documents").select("doc_id", F.explode(sequential.chapters_of(book)).alias("c"))
    return found.select("doc_id", "c.chapter", F.length("c.text").alias("n"))


_COUNTS = r"regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]|[a-zA-Z0-9_]+')"


@query(rf"""WITH t AS (SELECT chunk_id, {_COUNTS} AS t FROM chunks), c AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t), h AS (SELECT chunk_id, len(t) AS size, unnest(t) AS tok FROM t),
q AS (SELECT chunk_id, size, tok, count(*) AS tf FROM h WHERE tok IN ('released', 'license') GROUP BY ALL), df AS (SELECT tok, count(*) AS df FROM q GROUP BY 1)
SELECT chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 4) AS score FROM q JOIN df USING (tok) CROSS JOIN c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def indexed_text_search(spark, d):
    """The stored inverted table answers like a scan of the texts."""
    c, where = chunks(spark, d), shared_folder(spark)
    vectors.text_index(c, "chunk_id", "text").write.parquet(where)
    n, mean = c.agg(F.count("*"), F.avg(F.array_size(text.tokens(F.col("text"))))).first()
    return vectors.search_index(spark.read.parquet(where), "chunk_id", ["released", "license"], n, mean)


@query(rf"""WITH t AS (SELECT chunk_id, {_COUNTS} AS t FROM chunks), c AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t), h AS (SELECT chunk_id, len(t) AS size, unnest(t) AS tok FROM t),
q AS (SELECT chunk_id, size, tok, count(*) AS tf FROM h WHERE tok IN ('released', 'license') GROUP BY ALL), df AS (SELECT tok, count(*) AS df FROM q GROUP BY 1)
SELECT chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 4) AS score FROM q JOIN df USING (tok) CROSS JOIN c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def method_fulltext(spark, d):
    return service.text_search(chunks(spark, d), "released license", 5)


# Vectors, and what is written and read again


@query("SELECT vec_id, vec_id % 3 > 0 AS valid FROM embeddings", False)
def vectors_valid(spark, d):
    e = table(spark, d, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0]
    broken = F.when(F.col("vec_id") % 6 == 0, F.slice("embedding", 1, size - 1)).when(F.col("vec_id") % 6 == 3, F.transform("embedding", lambda x: F.lit(float("nan")))).otherwise(F.col("embedding"))
    return e.select("vec_id", vectors.valid_vector(broken, size).alias("valid"))


@query("SELECT vec_id::VARCHAR AS chunk_id, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings", False)
def vectors_restored(spark, d):
    where = shared_folder(spark)
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    files.backup(nodes(spark, d), edges(spark, d, ("LOCATED_IN",)), where, v)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return files.restore_vectors(spark, where).select("chunk_id", F.size("embedding").alias("n"), F.round(total, 4).alias("total"))


@query("SELECT true AS same, false AS other", False)
def backups_verified(spark, d):
    where = shared_folder(spark)
    n, e = nodes(spark, d), edges(spark, d, ("LOCATED_IN",))
    before = files.backup(n, e, where)
    after = files.counts(*files.restore(spark, where))
    return spark.createDataFrame([(files.verified(before, after), files.verified(before, files.counts(n.limit(1), e)))], "same boolean, other boolean")


@query("SELECT 'local-hash' AS kind, 'hash-v1' AS model, 256::INT AS dimension, 'local-hash:hash-v1:256' AS fingerprint, count(*) AS n FROM documents", False)
def index_described(spark, d):
    where = shared_folder(spark)
    retrieval.build_index(chunks(spark, d), retrieval.Embedder(), where)
    meta = retrieval.read_meta(spark, where)
    n = spark.read.parquet(f"{where}/vectors").count()
    return spark.createDataFrame([(meta["kind"], meta["model"], meta["dimension"], meta["fingerprint"], n)], "kind string, model string, dimension int, fingerprint string, n long")


@query("SELECT c_name AS a, c_mktsegment AS b, NULL::VARCHAR AS decision, 'today' AS made FROM customer", False)
def candidates_written(spark, d):
    where = shared_folder(spark)
    files.write_candidates(table(spark, d, "customer").select(F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b")), where, made="today")
    return spark.read.option("header", True).csv(where).toDF("a", "b", "decision", "made")


@query("SELECT name, round(degree, 6) AS centrality FROM (WITH near AS (SELECT src AS a, dst AS b FROM edges WHERE type = 'LOCATED_IN' UNION SELECT dst, src FROM edges WHERE type = 'LOCATED_IN') SELECT a AS name, count(*) / ((SELECT count(*) FROM nation) + (SELECT count(*) FROM region) - 1) AS degree FROM near GROUP BY 1) ORDER BY 2 DESC, 1 LIMIT 3")
def most_central(spark, d):
    n = nodes(spark, d).where(F.col("label").isin("门派", "地点")).select("name")
    return graph.degree_centrality(n, edges(spark, d, ("LOCATED_IN",)), 3).select("name", "centrality")
