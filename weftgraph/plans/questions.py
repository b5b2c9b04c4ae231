"""Queries about linking, evidence, contexts, vectors, ingestion state and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators import evaluate, evidence, extract, graph, linking, match, retrieval, service, vectors
from weftgraph.plans.projection import chunks, edges, nodes, shared_folder, table
from weftgraph.plans.registry import query
from weftgraph.schema import ALIAS, ART, NOISE_NAMES, PERSON, SECT
from weftgraph.sources import state

# Linking

_ALIASES = f"""x AS (SELECT 'al' || c_custkey AS alias, c_name AS canonical, '{PERSON}' AS label, CASE WHEN c_custkey % 2 = 0 THEN ['BUILDING'] ELSE ['BUILDING', 'MACHINERY'] END AS eras FROM customer
  UNION ALL SELECT 'al' || c_custkey, 'other', NULL, [] FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_name, c_name, '{PERSON}', [] FROM customer WHERE c_custkey % 7 = 0)"""


def _aliases(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    none, blank = F.array().cast("array<string>"), F.lit("")
    row = lambda df, alias, canonical, label, eras: df.select(alias.alias("alias"), canonical.alias("canonical"), F.lit(label).cast("string").alias("label"), eras.alias("applicable_eras"), blank.alias("source"), blank.alias("note"))
    called = F.concat(F.lit("al"), F.col("c_custkey").cast("string"))
    eras = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("BUILDING"))).otherwise(F.array(F.lit("BUILDING"), F.lit("MACHINERY")))
    out = row(c, called, F.col("c_name"), PERSON, eras).unionByName(row(c.where("c_custkey % 5 = 0"), called, F.lit("other"), None, none))
    return out.unionByName(row(c.where("c_custkey % 7 = 0"), F.col("c_name"), F.col("c_name"), PERSON, none))


_OWN = f"n AS (SELECT label, CASE c_k % 6 WHEN 0 THEN '师父' WHEN 1 THEN name || '的徒弟' ELSE name END AS name, era FROM (SELECT *, coalesce(try_cast(right(name, 3) AS INT), 2) AS c_k FROM nodes WHERE label = '{PERSON}') UNION ALL SELECT label, name, era FROM nodes WHERE label <> '{PERSON}')"


def _own(spark, d) -> DataFrame:
    """Nodes, some persons of which have names that are none."""
    n = nodes(spark, d)
    k = F.coalesce(F.try_to_number(F.substring("name", -3, 3), F.lit("999")).cast("int"), F.lit(2)) % 6
    person = F.col("label") == PERSON
    return n.withColumn("name", F.when(person & (k == 0), "师父").when(person & (k == 1), F.concat("name", F.lit("的徒弟"))).otherwise(F.col("name")))


@query(f"""WITH {_OWN}, {_ALIASES}, o AS (SELECT DISTINCT name AS form, name AS canonical, label, era, 'graph' AS source FROM n WHERE length(name) > 1 AND name NOT IN ({", ".join(repr(x) for x in NOISE_NAMES)}) AND name NOT LIKE '%的%')
SELECT * FROM o UNION ALL SELECT alias, canonical, label, CASE WHEN len(eras) = 1 THEN eras[1] END, 'alias' FROM x WHERE alias <> canonical""")
def lexicon_entries(spark, d):
    return linking.lexicon(_own(spark, d), _aliases(spark, d))


@query(f"""WITH {_ALIASES} SELECT alias AS form, max(canonical) AS canonical FROM x WHERE alias <> canonical GROUP BY 1 HAVING count(DISTINCT canonical) = 1 AND max(canonical) IN (SELECT name FROM nodes WHERE label = '{PERSON}')""")
def alias_names(spark, d):
    return linking.alias_mapping(linking.lexicon(nodes(spark, d), _aliases(spark, d)), PERSON)


@query(f"""WITH q AS (SELECT c_custkey AS id, c_name, c_custkey % 6 AS k FROM customer)
SELECT id, CASE k WHEN 0 THEN 'person_relation' WHEN 1 THEN 'sect' WHEN 2 THEN 'art' WHEN 5 THEN 'person' ELSE 'general' END AS intent,
  CASE k WHEN 1 THEN '{SECT}::丐帮' WHEN 2 THEN '{ART}::降龙掌' WHEN 4 THEN '' ELSE '{PERSON}::' || c_name END AS seed_id,
  CASE k WHEN 0 THEN 'triples' WHEN 1 THEN 'subgraph' WHEN 2 THEN 'path' WHEN 5 THEN 'path' ELSE 'text' END AS injection, CASE k WHEN 3 THEN 0.4 WHEN 4 THEN 0.2 ELSE 0.9 END::DOUBLE AS confidence FROM q""", False)
def intents_of_questions(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 6
    person = F.struct(F.col("c_name").alias("canonical"), F.lit(PERSON).alias("label"), F.lit(0.9).alias("confidence"))
    other = lambda name, label: F.struct(F.lit(name).alias("canonical"), F.lit(label).alias("label"), F.lit(0.9).alias("confidence"))
    forms = F.array(*[F.lit(x) for x in ("%s的父亲是谁", "%s所在的丐帮有哪些成员", "%s的降龙掌传给谁", "%s是谁", "这里有什么", "%s的师父是谁")])
    links = F.when(k == 4, F.array().cast("array<struct<canonical:string,label:string,confidence:double>>")).when(k == 1, F.array(person, other("丐帮", SECT))).when(k == 2, F.array(person, other("降龙掌", ART))).otherwise(F.array(person))
    q = c.select(F.col("c_custkey").alias("id"), F.replace(F.get(forms, k.cast("int")), F.lit("%s"), F.col("c_name")).alias("question"), links.alias("links"))
    return linking.intents(q).select("id", "intent", "seed_id", "injection", F.col("confidence").cast("double").alias("confidence"))


# Evidence and contexts


def _shapes(spark, d) -> DataFrame:
    """A row of evidence of each customer, in one of five shapes."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 5
    is_ = lambda n, v: F.when(k == n, v)
    return c.select(
        F.col("c_custkey").alias("id"), is_(0, F.col("c_name")).alias("name"), is_(0, F.lit(2)).alias("depth"), is_(1, F.col("c_name")).alias("from"), is_(1, F.lit("乙")).alias("to"), is_(2, F.col("c_name")).alias("person"),
        is_(2, F.array(F.lit("掌"), F.lit("剑"))).alias("arts"), is_(3, F.col("c_name")).alias("source"), is_(3, F.lit("乙")).alias("target"), is_(3, F.lit("spouse_of")).alias("rel"),
        is_(4, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("chunk_id"), is_(4, F.col("c_name")).alias("content"),
    )


@query("""SELECT c_custkey AS id, ['chain', 'art', 'member', 'triple', 'chunk'][1 + c_custkey % 5] AS kind, CASE c_custkey % 5 WHEN 0 THEN c_name || '（第2代）' WHEN 1 THEN c_name || ' -> 乙' WHEN 2 THEN c_name || '：掌、剑' WHEN 3 THEN c_name || ' spouse_of 乙' ELSE c_name END AS text,
CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 2 THEN c_name || ',掌,剑' WHEN 4 THEN '' ELSE c_name || ',乙' END AS names, CASE c_custkey % 5 WHEN 1 THEN 'inferred' WHEN 2 THEN 'extracted' WHEN 3 THEN 'extracted' END AS confidence, CASE WHEN c_custkey % 5 = 4 THEN 'c' || c_custkey ELSE '' END AS chunk_ids FROM customer""", False)
def evidence_normalized(spark, d):
    rows = evidence.normalized(_shapes(spark, d), "m")
    names = evidence.entity_names(F.array("bundle"))
    return rows.select("id", "bundle.kind", "bundle.text", F.array_join(names, ",").alias("names"), F.get("bundle.edges", F.lit(0))["confidence"].alias("confidence"), F.array_join("bundle.chunk_ids", ",").alias("chunk_ids"))


def _bundles(spark, d) -> DataFrame:
    """Two bundles of each customer: what the sect is, and what the customer knows."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    belongs = evidence.edge(F.col("c_name"), F.col("n_name"), F.lit("BELONGS_TO"))
    knows = evidence.edge(F.col("c_name"), F.lit("掌"), F.lit("MASTERS"), confidence=F.when(F.col("c_custkey") % 2 == 0, "inferred").otherwise("extracted"), snippets=F.array(F.concat(F.col("c_name"), F.lit("打出一掌"))))
    kind = F.when(F.col("c_custkey") % 3 == 0, "path").otherwise("triple")

    def made(seed, *found):
        one = F.struct(kind.alias("kind"), F.lit("m").alias("source_method"), F.lit("extracted").alias("confidence"), seed.alias("seed"), F.lit(True).alias("complete"), F.array().cast(evidence.NODES).alias("nodes"), F.array(*found).alias("edges"), F.array().cast("array<string>").alias("chunk_ids"), F.lit("").alias("text"))
        return one.cast(evidence.BUNDLE)

    return c.select(F.col("c_custkey").alias("id"), "c_name", "n_name", F.array(made(F.col("n_name"), belongs, knows), made(F.lit("").cast("string"), belongs)).alias("bundles"))


_LINE = "c_name || ' ->[属于] ' || n_name"
_KNOWS = "c_name || ' ->[精通] 掌' || CASE WHEN c_custkey % 2 = 0 THEN '（推断）' ELSE '' END || '｜原文：' || c_name || '打出一掌'"


@query(f"""SELECT c_custkey AS id, '门派：' || n_name || chr(10) || c_name || '（会：掌）' || chr(10) || c_name AS sect, {_LINE} || chr(10) || {_KNOWS} AS path,
CASE WHEN c_custkey % 3 = 0 THEN {_LINE} || '；' || {_KNOWS} || chr(10) || {_LINE} ELSE '（' || c_name || '，属于，' || n_name || '）' || chr(10) || '（' || c_name || '，精通，掌）' END AS person, 'raw' AS text,
c_name || ',' || n_name || ',掌' AS nodes, 2::INT AS n_edges, c_name || ':BELONGS_TO:' || n_name || ' ' || c_name || ':MASTERS:掌' AS facts FROM customer JOIN nation ON c_nationkey = n_nationkey""", False)
def contexts_built(spark, d):
    b = F.col("bundles")
    of = lambda method: evidence.context(F.lit(method), b, F.lit(" raw "))
    path = evidence.path_of(b, F.lit(""))
    facts = F.transform(evidence.facts(b), lambda f: F.concat_ws(":", f["src"], f["type"], f["dst"]))
    return _bundles(spark, d).select("id", of("sect_agg").alias("sect"), of("cross_novel").alias("path"), of("person_relation").alias("person"), of("vector").alias("text"), F.array_join(path["nodes"], ",").alias("nodes"), F.size(path["edges"]).alias("n_edges"), F.array_join(facts, " ").alias("facts"))


# Patterns and graphs


@query("""WITH s AS (SELECT src, type, dst FROM edges WHERE type = 'LOCATED_IN') SELECT src, type, dst FROM s UNION ALL (SELECT DISTINCT src, type, dst FROM edges WHERE type = 'FOUNDER_OF')""")
def subgraph_with_path(spark, d):
    e = edges(spark, d, ("LOCATED_IN", "FOUNDER_OF"))
    return match.with_path_edges(e.where("type = 'LOCATED_IN'"), e.unionByName(e))


@query("""SELECT 'founder' AS kind, c_name AS name FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT 'art', c_name FROM customer WHERE c_custkey % 10 = 2""", False)
def patterns_outside_the_ontology(spark, d):
    c = table(spark, d, "customer")
    row = lambda df, kind, a, src, b, dst: df.select(F.lit(kind).alias("type"), F.lit(a).alias("src_label"), src.alias("src"), F.lit(b).alias("dst_label"), dst.alias("dst"), F.array().cast("array<string>").alias("chunk_ids"))
    e = row(c.where("c_custkey % 10 = 1"), "FOUNDER_OF", PERSON, F.col("c_name"), ART, F.lit("掌")).unionByName(row(c.where("c_custkey % 10 = 2"), "MASTERS", SECT, F.lit("丐帮"), ART, F.col("c_name")))
    e = e.unionByName(row(c, "FOUNDER_OF", PERSON, F.col("c_name"), SECT, F.lit("掌"))).unionByName(row(c, "MASTERS", PERSON, F.lit("丐帮"), ART, F.col("c_name")))
    return match.art_founders(e, "掌").select(F.lit("founder").alias("kind"), F.col("person").alias("name")).unionByName(match.sect_own_arts(e, "丐帮").select(F.lit("art").alias("kind"), F.col("art").alias("name")))


@query("""WITH k AS (SELECT src, type, dst FROM edges WHERE type IN ('PARENT_OF', 'SPOUSE_OF') AND src IN (SELECT c_name FROM customer WHERE c_custkey % 3 > 0) AND dst IN (SELECT c_name FROM customer WHERE c_custkey % 3 > 0))
SELECT src AS name, dst AS other, type FROM k UNION ALL SELECT dst, src, type FROM k WHERE src <> dst""")
def adjacency_with_all_edges(spark, d):
    names = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_name").alias("name"))
    return graph.adjacency(names, edges(spark, d, ("PARENT_OF", "SPOUSE_OF"))).select("name", "other", "type")


@query()
def graph_analysis(spark, d):
    e = edges(spark, d, ("PARENT_OF", "SPOUSE_OF"))
    return graph.analyze(table(spark, d, "customer").select(F.col("c_name").alias("name")), e)


# Vectors

_TOKEN = r"regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]|[a-zA-Z0-9_]+')"


def hashed_sql(rows: str, key: str) -> str:
    """key, slot, w of the hashed vectors of rows (key, text), as SQL."""
    return f"""(WITH t AS (SELECT {key}, unnest({_TOKEN}) AS tok FROM ({rows})), h AS (SELECT {key}, sha256(tok) AS x FROM t),
  s AS (SELECT {key}, (('0x' || substr(x, 1, 8))::BIGINT % 256) AS slot, CASE WHEN ('0x' || substr(x, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM h), c AS (SELECT {key}, slot, sum(sign) AS n FROM s GROUP BY 1, 2 HAVING sum(sign) <> 0)
  SELECT {key}, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY {key})), 6) AS w FROM c)"""


def similar_sql(question: str, k: int) -> str:
    """chunk_id, score of the chunks most like a question by hashed vectors, as SQL tables v, q, best."""
    return f"""v AS {hashed_sql("SELECT chunk_id, text FROM chunks", "chunk_id")}, q AS {hashed_sql(f"SELECT 0 AS id, '{question}' AS text", "id")}, z AS (SELECT chunk_id, sum(w * w) AS m FROM v GROUP BY 1), p AS (SELECT chunk_id, sum(v.w * q.w) AS p FROM v JOIN q USING (slot) GROUP BY 1),
best AS (SELECT c.chunk_id, round(coalesce(p / (sqrt(m) * sqrt((SELECT sum(w * w) FROM q))), 0), 6) AS score FROM chunks c LEFT JOIN z USING (chunk_id) LEFT JOIN p USING (chunk_id) ORDER BY 2 DESC, 1 LIMIT {k})"""


@query(f"WITH {similar_sql('released license', 5)} SELECT chunk_id, score FROM best")
def method_vector(spark, d):
    return service.vector_search(chunks(spark, d), "released license", 5).select("chunk_id", "score")


@query(f"WITH {similar_sql('the license of the city', 20)} SELECT b.chunk_id, b.score FROM best b JOIN chunks c USING (chunk_id) WHERE c.era = 'en'")
def indexed_search_of_an_era(spark, d):
    where, embedder = shared_folder(spark), retrieval.Embedder()
    retrieval.build_index(chunks(spark, d).withColumn("chapter", F.lit(None).cast("string")), embedder, where)
    return retrieval.search(spark, where, "the license of the city", embedder, 20, "en").where("era = 'en'").select("chunk_id", "score")


@query(rf"""WITH t AS (SELECT chunk_id, {_TOKEN} AS t FROM chunks), h AS (SELECT chunk_id, len(t) AS size, unnest(t) AS token FROM t) SELECT token, count(*) AS df, sum(tf)::BIGINT AS n, max(size)::INT AS longest FROM (SELECT token, chunk_id, size, count(*) AS tf FROM h GROUP BY ALL) GROUP BY 1""")
def text_index_by_token(spark, d):
    index = vectors.text_index(chunks(spark, d), "chunk_id", "text")
    return index.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("n"), F.max("size").alias("longest"))


# Ingestion state


@query("SELECT 'c' || c_custkey AS chunk_id FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 8 = 0 OR c_custkey % 12 = 4", False)
def chunks_to_do(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("chunk_id"), F.col("c_name").alias("content_hash"), "c_custkey")
    done = c.where("c_custkey % 4 = 0").select("chunk_id", F.when(F.col("c_custkey") % 8 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("c_custkey") % 12 == 4, "retryable").otherwise("ok").alias("status"), F.lit("").alias("error"))
    where, mark = shared_folder(spark), state.Signature("b", "v2", "abc")
    state.write_checkpoint(done, where, mark)
    return state.to_do(c, state.read_checkpoint(spark, where, mark)).select("chunk_id")


@query("SELECT DISTINCT c_name AS id FROM customer WHERE c_custkey % 3 > 0", False)
def log_of_done_ids(spark, d):
    where = shared_folder(spark)
    c = table(spark, d, "customer")
    state.append_log(c.where("c_custkey % 3 = 1").select(F.col("c_name").alias("id")), where)
    state.append_log(c.where("c_custkey % 3 > 0").select(F.col("c_name").alias("id"), F.lit("x").alias("answer")), where)
    c.where("c_custkey % 3 = 0").select(F.concat(F.lit("not json "), "c_name")).write.mode("append").text(where)
    return state.done_ids(spark, where)


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 'nodes' ELSE 'edges' END AS name, count(*) AS n FROM events GROUP BY 1""", False)
def committed_versions(spark, d):
    e, where = table(spark, d, "events").select("event_id"), shared_folder(spark)
    state.commit(spark, where, {"nodes": e.limit(0), "edges": e.where("event_id % 2 = 1")})
    state.commit(spark, where, {"nodes": e.where("event_id % 2 = 0")})
    parts = [state.read_version(spark, where, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in ("nodes", "edges")]
    return parts[0].unionByName(parts[1])


@query("""WITH d AS (SELECT doc_id % 3 AS k FROM documents) SELECT 'records' AS name, count(*) AS n FROM d UNION ALL SELECT 'reparsed', count(*) FROM d WHERE k < 2 UNION ALL SELECT 'still_invalid', count(*) FROM d WHERE k = 2
UNION ALL SELECT 'entities', 2 * count(*) FROM d WHERE k = 0 UNION ALL SELECT 'relationships', 2 * count(*) FROM d WHERE k = 0 UNION ALL SELECT 'rejected', count(*) FROM d WHERE k = 0 UNION ALL SELECT 'examples', least(5, count(*)) FROM d WHERE k = 2""", False)
def reparse_figures(spark, d):
    c = chunks(spark, d)
    good = '{"entities":[{"name":"郭靖","type":"人物"},{"name":"黄蓉","type":"人物"}],"relationships":[{"source":"郭靖","target":"黄蓉","type":"SPOUSE_OF"},{"source":"郭靖","target":"杨康","type":"ENEMY_OF"}]}'
    raw = F.when(F.col("doc_id") % 3 == 0, good).when(F.col("doc_id") % 3 == 1, '{"entities":[],"relationships":[]}').otherwise("no json")
    body = F.concat(F.lit("郭靖娶黄蓉为妻。"), F.coalesce("text", F.lit("")))
    return state.reparse(c.select("chunk_id", "era", body.alias("text"), raw.alias("raw"))).select("name", "n")


@query("SELECT source AS book, min(lang) AS era, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1", False)
def stored_manifest(spark, d):
    where = shared_folder(spark)
    state.write_manifest(chunks(spark, d), where, "v2")
    found = state.update_manifest(spark, where, extraction={"model": "m"})
    rows = [(book, v["era"], v["chunk_count"], v["total_chars"]) for book, v in found["books"].items()]
    return spark.createDataFrame(rows, "book string, era string, n_chunks long, n_chars long")


@query(f"""WITH {_ALIASES} SELECT alias, canonical, label, array_to_string(eras, ',') AS eras FROM x""")
def aliases_saved(spark, d):
    where = shared_folder(spark)
    state.save_aliases(_aliases(spark, d), where)
    return state.load_aliases(spark, where).select("alias", "canonical", "label", F.array_join("applicable_eras", ",").alias("eras"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'retryable' ELSE 'fatal' END AS status FROM documents", False)
def extraction_states(spark, d):
    c = chunks(spark, d)
    answer = F.when(F.col("doc_id") % 4 == 0, '{"entities":[{"name":"郭靖","type":"人物"}],"relationships":[]}').when(F.col("doc_id") % 4 == 1, "{}").when(F.col("doc_id") % 4 == 2, "none")
    error = F.when(F.col("doc_id") % 4 == 3, "AuthenticationError: no")
    return extract.parse(c.withColumn("answer", answer).withColumn("error", error)).select("doc_id", "status")


@query("SELECT doc_id, '黄蓉' AS name, '人物' AS kept, '门派' AS given FROM documents WHERE doc_id % 2 = 0", False)
def entity_type_conflicts(spark, d):
    c = chunks(spark, d)
    said = '{"entities":[{"name":"黄蓉","type":"人物"},{"name":"郭靖","type":"人物"},{"name":"黄蓉","type":"门派"},{"name":"郭靖","type":"人物"}],"relationships":[]}'
    parsed = extract.parse(c.withColumn("answer", F.when(F.col("doc_id") % 2 == 0, said).otherwise("{}")))
    return extract.type_conflicts(parsed).join(c.select("chunk_id", "doc_id"), "chunk_id").select("doc_id", "name", "kept", "given")


@query(r"""SELECT doc_id, CASE WHEN two IS NOT NULL THEN left(two, 160) WHEN one IS NOT NULL THEN left(one, 160) ELSE left(text, 160) END AS snippet FROM (SELECT doc_id, text, list_filter(s, lambda x: contains(x, 'the') AND contains(x, 'license'))[1] AS two, list_filter(s, lambda x: contains(x, 'the') OR contains(x, 'license'))[1] AS one
FROM (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;\n]*[。！？!?；;\n]|[^。！？!?；;\n]+$'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS s FROM documents))""", False)
def snippets_of_names(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.snippet(t, F.lit("the"), F.lit("license")).alias("snippet"))


@query("""SELECT l_orderkey AS question_id, o_orderpriority AS category, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""", False)
def results_by_category(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"), F.lit(1).alias("hop"), F.lit("").alias("source_hint"))
    return evaluate.with_questions(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id")), q).groupBy("question_id", "category").agg(F.count("*").alias("n"))


# Evaluation

_JUDGED = "SELECT c_custkey AS id, c_custkey % 4 AS k, c_name FROM customer"


@query(f"""WITH j AS ({_JUDGED}) SELECT id, k < 2 AS hit, CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS entity_recall, k % 2 = 0 AS exact_match, CASE WHEN k = 3 THEN 0.0 WHEN k = 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS path_completeness,
CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS evidence_sufficiency, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS path_validity, CASE k WHEN 3 THEN 0 ELSE 2 END::INT AS evidence_count FROM j""", False)
def answers_evaluated(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 4
    step = lambda a, b, kind, way="forward": F.struct(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), F.lit(way).alias("direction"))
    one, two, three = F.col("c_name"), F.lit("乙"), F.lit("丙")
    paths = F.when(k == 0, F.array(step(one, two, "PARENT_OF"), step(two, three, "PARENT_OF"))).when(k == 1, F.array(step(one, two, "PARENT_OF"), step(two, three, "LOVES"))).when(k == 2, F.array(step(one, two, "PARENT_OF"), step(three, one, "PARENT_OF", "backward")))
    none = F.array().cast("array<struct<src:string,dst:string,type:string,direction:string>>")
    rows = c.select(
        F.col("c_custkey").alias("id"), F.when(k < 2, F.concat(F.lit("是"), one)).otherwise(F.concat(F.lit("不是"), one)).alias("answer"), F.array(one).alias("accepted"),
        F.when(k % 2 == 0, F.array(one)).otherwise(F.array(one, F.lit("x"))).alias("expected"), F.array(one).alias("answered"), F.coalesce(paths, none).alias("edges"), F.lit(2).alias("hop"), F.lit("父亲").alias("relation"),
    )
    found = evaluate.evaluated(rows)
    return found.select("id", "hit", "entity_recall", "exact_match", "path_completeness", "evidence_sufficiency", "path_validity", "evidence_count")


@query(f"""WITH c AS (SELECT 'o' || o_orderkey AS chunk_id, o_orderpriority AS text FROM orders), e AS (SELECT type, src, dst, 'o' || chunk_ids[1] AS chunk_id FROM edges WHERE type = 'MASTER_OF')
SELECT 'snippets' AS section, 'quoted' AS name, count(*) AS n FROM e UNION ALL SELECT 'snippets', 'chunk_exists', count(*) FROM e JOIN c USING (chunk_id) UNION ALL SELECT 'snippets', 'snippet_in_chunk', count(*) FROM e JOIN c USING (chunk_id) WHERE contains(text, 'URGENT')
UNION ALL SELECT 'evidence', 'all', count(*) FROM e UNION ALL SELECT 'evidence', 'with_chunks', count(*) FROM e UNION ALL SELECT 'evidence', 'with_snippets', count(*) FROM e
UNION ALL SELECT 'entities', label || '/' || coalesce(era, '<null>'), count(*) FROM nodes GROUP BY label, era UNION ALL SELECT 'attributes', 'all', count(*) FROM nodes UNION ALL SELECT 'attributes', 'location', count(*) FROM nodes WHERE label = '{SECT}'
UNION ALL SELECT 'attributes', 'description', count(*) FROM nodes WHERE label = '{PERSON}' UNION ALL SELECT 'attributes', 'described', count(*) FROM nodes WHERE label = '{PERSON}' AND era IS NOT NULL UNION ALL SELECT 'attributes', 'art_type', 0
UNION ALL SELECT 'chunks', '1995/v2', count(*) FROM c UNION ALL SELECT 'embedded', '1995/v2', count(*) FROM c WHERE contains(text, 'URGENT')""")
def graph_verified(spark, d):
    n = nodes(spark, d).withColumn("description", F.when(F.col("label") == PERSON, F.coalesce("era", F.lit("")))).withColumn("location", F.when(F.col("label") == SECT, F.lit("x"))).withColumn("art_type", F.lit(None).cast("string"))
    e = edges(spark, d, ("MASTER_OF",)).withColumn("chunk_ids", F.transform("chunk_ids", lambda i: F.concat(F.lit("o"), i))).withColumn("snippets", F.array(F.lit("URGENT")))
    o = table(spark, d, "orders")
    urgent = F.when(F.col("o_orderpriority").contains("URGENT"), F.array(F.lit(1.0)))
    c = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("chunk_id"), F.lit("1995").alias("book"), F.lit("v2").alias("dataset_version"), F.col("o_orderpriority").alias("text"), urgent.alias("embedding"))
    return evaluate.verification(n, e, c)


@query()
def questions_run(spark, d):
    e = edges(spark, d, ("BELONGS_TO", "PARENT_OF", "SPOUSE_OF"))
    small = chunks(spark, d).select("chunk_id", "text")
    engine = service.Engine(spark, nodes(spark, d), e, small, aliases=spark.createDataFrame([("小三", "Customer#000000003", PERSON, [], "", "")], ALIAS))
    asked = [
        {"id": "1", "question": "Customer#000000004的父亲是谁", "category": "人物", "hop": 1, "acceptable_answers": ["Customer#000000001"]},
        {"id": "2", "question": "小三的妻子是谁", "category": "人物", "hop": 1, "acceptable_answers": ["Customer#000000002"]},
        {"id": "3", "question": " ", "category": "人物", "hop": 1, "acceptable_answers": []}, {"id": "4", "question": "done", "category": "人物", "hop": 1, "acceptable_answers": []},
    ]
    return evaluate.run(engine, asked, done=["4"]).select("id", "method", "status", "seed", "hit", "evidence_count", "confidence")


@query("SELECT kind, n FROM (SELECT 'nodes' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges WHERE type IN ('BELONGS_TO', 'LOCATED_IN'))")
def queries_with_parameters(spark, d):
    engine = service.Engine(spark, nodes(spark, d), edges(spark, d, ("BELONGS_TO", "LOCATED_IN", "FOUNDER_OF")), chunks(spark, d))
    return engine.query("SELECT 'nodes' AS kind, count(*) AS n FROM nodes WHERE :eras IS NULL OR array_contains(:eras, era) UNION ALL SELECT 'edges', count(*) FROM edges WHERE array_contains(:types, type)", {"types": F.array(F.lit("BELONGS_TO"), F.lit("LOCATED_IN"))})
