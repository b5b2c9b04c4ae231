"""Queries about upkeep of the graph, evidence, contexts and routed answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import align, answer, evaluate, graph, maintain, merge, service, stats, store
from weftgraph.plans.projection import chunks, edges, nodes, table
from weftgraph.plans.questions import similar_sql
from weftgraph.plans.registry import query
from weftgraph.schema import ART, PERSON, SECT


def _c(spark, d) -> DataFrame:
    return table(spark, d, "customer")


# Upkeep

_RULES = f"""r AS (SELECT c_name AS name, '{PERSON}' AS label, 'canon' || (c_custkey % 7) AS canonical, CASE WHEN c_custkey % 2 = 0 THEN ['BUILDING', 'MACHINERY'] ELSE [] END AS eras, c_custkey AS ord FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_name, '{PERSON}', 'late', [], 100000000 + c_custkey FROM customer WHERE c_custkey % 6 = 0)"""


def _rules(spark, d):
    c = _c(spark, d)
    none = F.array().cast("array<string>")
    a = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("alias"), F.concat(F.lit("canon"), (F.col("c_custkey") % 7).cast("string")).alias("canonical"), F.lit(PERSON).alias("label"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).otherwise(none).alias("applicable_eras"), F.col("c_custkey").alias("ord"))
    b = c.where("c_custkey % 6 = 0").select(F.col("c_name").alias("alias"), F.lit("late").alias("canonical"), F.lit(PERSON).alias("label"), none.alias("applicable_eras"), (F.col("c_custkey") + 100000000).alias("ord"))
    return a.unionByName(b)


@query(f"WITH {_RULES} SELECT n.name, n.era, (SELECT arg_min(canonical, ord) FROM r WHERE r.name = n.name AND r.label = n.label AND (n.era IS NULL OR len(eras) = 0 OR list_contains(eras, n.era))) AS canonical FROM nodes n WHERE label = '{PERSON}'")
def alias_rules_applied(spark, d):
    return maintain.match_aliases(nodes(spark, d).where(F.col("label") == PERSON), _rules(spark, d)).select("name", "era", "canonical")


# Each customer is also called 大侠 in the same era: by rule that is the customer, unless the dictionary knows better or calls the name canonical.
@query(f"""WITH {_RULES}, p AS (SELECT name, label, era FROM nodes WHERE label = '{PERSON}' UNION ALL SELECT c_name || '大侠', '{PERSON}', c_mktsegment FROM customer),
m AS (SELECT p.name AS alias, (SELECT arg_min(canonical, ord) FROM r WHERE r.name = p.name AND r.label = p.label AND (p.era IS NULL OR len(eras) = 0 OR list_contains(eras, p.era))) AS canonical FROM p),
l AS (SELECT alias, 'dictionary' AS source FROM m WHERE canonical <> alias UNION ALL SELECT c_name, 'rule' FROM customer WHERE c_name NOT IN (SELECT alias FROM m WHERE canonical <> alias))
SELECT source, count(DISTINCT alias) AS n FROM l GROUP BY 1""")
def decisions_by_source(spark, d):
    n = nodes(spark, d).where(F.col("label") == PERSON)
    heroes = _c(spark, d).select(F.lit(PERSON).alias("label"), F.concat("c_name", F.lit("大侠")).alias("name"), F.col("c_mktsegment").alias("era"))
    found = maintain.decisions(n.unionByName(heroes), _rules(spark, d))
    return found.groupBy("source").agg(F.count("*").alias("n"))


# Every third customer is a sect of another era, too.
@query(f"""WITH two AS (SELECT label, name, era FROM nodes UNION ALL SELECT '{SECT}', c_name, 'X' FROM customer WHERE c_custkey % 3 = 0), w AS (SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE c_mktsegment END AS era FROM customer)
SELECT w.name, w.era, (SELECT label FROM two WHERE two.name = w.name ORDER BY CASE WHEN two.era = w.era THEN 0 ELSE 1 END, label LIMIT 1) AS label FROM w""")
def era_scoped_lookup(spark, d):
    c = _c(spark, d)
    two = nodes(spark, d).unionByName(c.where("c_custkey % 3 = 0").select(F.lit(SECT).alias("label"), F.col("c_name").alias("name"), F.lit("X").alias("era")))
    wanted = c.select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "X").otherwise(F.col("c_mktsegment")).alias("era"))
    return maintain.nearest_node(wanted, two).select("name", "era", "label")


@query(f"""SELECT p_partkey AS id, [p_type] AS eras, coalesce(CASE WHEN p_size % 2 = 0 THEN '内功' END, CASE WHEN p_size % 3 = 0 THEN '外功' END) AS art_type FROM part""", False)
def attributes_backfilled(spark, d):
    p = table(spark, d, "part")
    none = F.lit(None).cast("array<string>")
    rows = p.select(
        F.col("p_partkey").alias("id"), F.lit(ART).alias("label"), F.col("p_type").alias("era"), none.alias("eras"), none.alias("books"), F.lit(None).cast("string").alias("first_seen_era"),
        F.when(F.col("p_size") % 2 == 0, "内功").alias("art_type"), F.when(F.col("p_size") % 3 == 0, "外功").otherwise("x").alias("type"),
    )
    return maintain.backfill(rows).select("id", "eras", "art_type")


@query("SELECT event_type AS chunk_id FROM events WHERE event_id % 3 <> 0", False)
def legacy_chunks_dropped(spark, d):
    e = table(spark, d, "events")
    return maintain.current_chunks(e.select(F.col("event_type").alias("chunk_id"), F.when(F.col("event_id") % 3 != 0, "v2").alias("dataset_version"))).select("chunk_id")


@query(f"SELECT label, name, coalesce(era, '-') AS era FROM nodes UNION ALL SELECT '{PERSON}', 'new' || n_nationkey, '未知' FROM nation")
def nodes_ensured(spark, d):
    n = table(spark, d, "nation").select(F.lit(PERSON).alias("label"), F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("name"))
    wanted = n.unionByName(n).unionByName(nodes(spark, d).select("label", "name"))
    return maintain.ensure_nodes(nodes(spark, d), wanted).withColumn("era", F.coalesce("era", F.lit("-")))


@query(f"SELECT label, name FROM nodes WHERE NOT (label = '{SECT}' AND name IN (SELECT n_name FROM nation WHERE n_nationkey % 5 = 0))")
def nodes_dropped(spark, d):
    gone = table(spark, d, "nation").where("n_nationkey % 5 = 0").select(F.lit(SECT).alias("label"), F.col("n_name").alias("name"))
    return store.drop_nodes(nodes(spark, d), edges(spark, d, ("BELONGS_TO",)), gone)[0].select("label", "name")


@query("SELECT type, src, dst FROM edges WHERE type IN ('BELONGS_TO', 'LOCATED_IN') AND src NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 5 = 0) AND dst NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 5 = 0)")
def edges_of_dropped_nodes(spark, d):
    gone = table(spark, d, "nation").where("n_nationkey % 5 = 0").select(F.lit(SECT).alias("label"), F.col("n_name").alias("name"))
    return store.drop_nodes(nodes(spark, d), edges(spark, d, ("BELONGS_TO", "LOCATED_IN")), gone)[1].select("type", "src", "dst")


_BORN = "SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '王' || chr((19968 + c_custkey % 50)::INT) || '之子，善战' WHEN c_custkey % 3 = 1 THEN '诸葛亮的女儿' ELSE '无名' END AS description FROM customer"


def _born(spark, d):
    c = _c(spark, d)
    sign = F.decode(F.unhex(F.concat(F.lit("FEFF"), F.lpad(F.hex(F.lit(19968) + F.col("c_custkey") % 50), 4, "0"))), "UTF-16")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("王"), sign, F.lit("之子，善战"))).when(F.col("c_custkey") % 3 == 1, "诸葛亮的女儿").otherwise("无名")
    return c.select(F.col("c_name").alias("name"), text.alias("description"))


@query(f"WITH b AS ({_BORN}) SELECT CASE WHEN description LIKE '%之子%' THEN left(description, 2) ELSE '诸葛亮' END AS ancestor, name AS descendant, CASE WHEN description LIKE '%之子%' THEN '之子' ELSE '之女' END AS kind FROM b WHERE description <> '无名'")
def ancestors_scanned(spark, d):
    return align.ancestors(_born(spark, d))


def _descent(spark, d):
    c = _c(spark, d)
    said = lambda rows, reason: rows.select(F.col("c_name").alias("ancestor"), F.lit("x").alias("descendant"), F.lit(reason).cast("string").alias("reason"))
    kept = c.where("c_custkey % 4 = 0").select(F.lit("DESCENDANT_OF").alias("type"), F.col("c_name").alias("src"), F.lit("x").alias("dst"), F.lit("extracted").alias("confidence"))
    found = said(c.where("c_custkey % 4 <= 1"), None)
    return maintain.add_descendants(kept, found.unionByName(found).unionByName(said(c.where("c_custkey % 4 = 2"), "self")))


@query("""SELECT 'DESCENDANT_OF' AS type, c_name AS src, 'x' AS dst, 'inferred' AS confidence FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT 'DESCENDANT_OF', c_name, 'x', 'extracted' FROM customer WHERE c_custkey % 4 = 0""", False)
def descendants_added(spark, d):
    return _descent(spark, d)[0]


@query("SELECT CASE c_custkey % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'created' ELSE 'pending' END AS status, count(*) AS n FROM customer WHERE c_custkey % 4 <= 2 GROUP BY 1", False)
def descendants_counted(spark, d):
    return _descent(spark, d)[1]


# Merging: of ten customers in a row the third and fourth are names of the second, the sixth one of a person that is not there yet.

_GROUPED = f"""m AS (SELECT '{PERSON}' AS label, c_name AS alias, CASE WHEN c_custkey % 10 IN (3, 4) THEN 'Customer#' || lpad((c_custkey - c_custkey % 10 + 2)::VARCHAR, 9, '0') ELSE 'new' || (c_custkey // 10) END AS canonical
FROM customer WHERE c_custkey % 10 IN (3, 4, 6)),
g AS (SELECT e.type, src_label, dst_label, coalesce(a.canonical, src) AS src, coalesce(b.canonical, dst) AS dst, a.canonical IS NOT NULL OR b.canonical IS NOT NULL AS moved, coalesce(a.canonical, b.canonical) AS canonical
  FROM edges e LEFT JOIN m a ON a.label = src_label AND a.alias = src LEFT JOIN m b ON b.label = dst_label AND b.alias = dst WHERE e.type IN ('PARENT_OF', 'SPOUSE_OF', 'BELONGS_TO'))"""


def _merged(spark, d):
    c = _c(spark, d).where("c_custkey % 10 IN (3, 4, 6)")
    second = F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") - F.col("c_custkey") % 10 + 2).cast("string"), 9, "0"))
    to = F.when((F.col("c_custkey") % 10).isin(3, 4), second).otherwise(F.concat(F.lit("new"), F.expr("c_custkey div 10").cast("string")))
    decisions = c.select(F.lit(PERSON).alias("label"), F.col("c_name").alias("alias"), to.alias("canonical"))
    return merge.merge(nodes(spark, d), edges(spark, d, ("PARENT_OF", "SPOUSE_OF", "BELONGS_TO")), decisions)


@query(f"""WITH {_GROUPED}, a AS (SELECT n.label, coalesce(m.canonical, n.name) AS name, n.name AS was, CASE WHEN m.canonical IS NULL THEN 0 ELSE 1 END AS rank, n.era FROM nodes n LEFT JOIN m ON m.label = n.label AND m.alias = n.name
  UNION ALL SELECT '{PERSON}', 'new' || (c_custkey // 10), 'new' || (c_custkey // 10), 0, '未知' FROM customer WHERE c_custkey % 10 = 6)
SELECT label, name, arg_min(era, (rank, was)) FILTER (WHERE era IS NOT NULL) AS era, coalesce(string_agg(was, ',' ORDER BY was) FILTER (WHERE rank = 1), '') AS aliases FROM a GROUP BY 1, 2""")
def nodes_merged(spark, d):
    return _merged(spark, d)[0].select("label", "name", "era", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ",").alias("aliases"))


@query(f"WITH {_GROUPED} SELECT DISTINCT type, src_label, src, dst_label, dst FROM g WHERE NOT (moved AND src_label = dst_label AND src = dst)")
def edges_merged(spark, d):
    return _merged(spark, d)[1].select("type", "src_label", "src", "dst_label", "dst")


@query(f"""WITH {_GROUPED}, k AS (SELECT type, src_label, src, dst_label, dst, bool_or(NOT moved) AS had, count(*) FILTER (WHERE moved) AS n, min(canonical) AS canonical FROM g WHERE NOT (moved AND src_label = dst_label AND src = dst) GROUP BY 1, 2, 3, 4, 5 HAVING n > 0),
s AS (SELECT sum(CASE WHEN had THEN 0 ELSE 1 END)::BIGINT AS created_edges, sum(n - CASE WHEN had THEN 0 ELSE 1 END)::BIGINT AS skipped_edges FROM k)
SELECT (SELECT count(*) FROM m) AS merged, created_edges, skipped_edges, (SELECT count(*) FROM g WHERE moved AND src_label = dst_label AND src = dst) AS dropped_edges, 0::BIGINT AS errors FROM s""")
def merge_report(spark, d):
    return _merged(spark, d)[2].agg(*[F.sum(c).alias(c) for c in ("merged", "created_edges", "skipped_edges", "dropped_edges", "errors")])


#: Names and whether they refer to someone instead of naming a person.
_CALLED = (("师父", True), ("徒弟", True), ("弟子", True), ("岳父", True), ("外公", True), ("仇敌", True), ("配偶", True), ("义兄", True), ("婴儿", True), ("某", True), ("黄药师", False), ("弟子规", False))


@query(f"SELECT c_custkey AS id, CASE c_custkey % 16 " + " ".join(f"WHEN {k} THEN {r}" for k, (_, r) in enumerate(_CALLED)) + " WHEN 12 THEN true WHEN 13 THEN true ELSE false END AS reference FROM customer", False)
def person_references(spark, d):
    k = F.col("c_custkey") % 16
    name = F.coalesce(*[F.when(k == i, n) for i, (n, _) in enumerate(_CALLED)], F.when(k == 12, F.concat("c_name", F.lit("之女"))), F.when(k == 13, F.concat(F.lit("某人的"), F.col("c_name"))), F.col("c_name"))
    return _c(spark, d).select(F.col("c_custkey").alias("id"), maintain.is_reference(name).alias("reference"))


@query("SELECT label::VARCHAR AS book, 'v2' AS dataset_version, count(*) AS n, count(*) FILTER (WHERE vec_id % 3 > 0) AS n_embedded, min(len(embedding)) FILTER (WHERE vec_id % 3 > 0)::INT AS dim_min, max(len(embedding)) FILTER (WHERE vec_id % 3 > 0)::INT AS dim_max FROM embeddings GROUP BY 1", False)
def chunks_by_book_version(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("book"), F.lit("v2").alias("dataset_version"), F.when(F.col("vec_id") % 3 > 0, F.col("embedding")).alias("embedding"))
    return evaluate.embedded_chunks(rows)


@query("SELECT label, count(*) AS n, count(era) AS n_with_era, count(*) FILTER (WHERE era <> '') AS n_filled_era, count(*) FILTER (WHERE era IS NOT NULL) AS n_with_description, count(*) FILTER (WHERE era = 'MACHINERY') AS n_filled_description FROM nodes GROUP BY 1")
def entity_attributes(spark, d):
    described = F.when(F.col("era") == "MACHINERY", "x").when(F.col("era").isNotNull(), "")
    return evaluate.attributes(nodes(spark, d).withColumn("description", described))


@query("WITH e AS (SELECT src AS name FROM edges UNION ALL SELECT dst FROM edges) SELECT name, count(*) AS degree FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_degrees(spark, d):
    return graph.top_degrees(edges(spark, d), 20)


# Evidence and contexts

_NAMED = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in service.NAMES.items()) + " ELSE type END"


@query(f"""SELECT src, dst, src || ' ->[' || {_NAMED} || '] ' || dst AS arrow, '（' || src || '，' || {_NAMED} || '，' || dst || '）' AS triple, src || ' --[' || {_NAMED} || ']--> ' || dst AS step
FROM edges WHERE type IN ('SPOUSE_OF', 'LOCATED_IN', 'FOUNDER_OF')""")
def evidence_lines(spark, d):
    e = edges(spark, d, ("SPOUSE_OF", "LOCATED_IN", "FOUNDER_OF")).withColumn("direction", F.lit("forward"))
    return service.fact_lines(e).select("src", "dst", "arrow", "triple", "step")



def _fact_arrays(spark, d):
    e = edges(spark, d, ("BELONGS_TO",))
    return e.groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("src", "type", "dst"))).alias("facts"))


@query("""WITH f AS (SELECT dst, list_sort(list(src)) AS s FROM edges WHERE type = 'BELONGS_TO' GROUP BY 1)
SELECT dst, array_to_string(list_transform(s, lambda x: '（' || x || '，属于，' || dst || '）'), chr(10)) AS triples, array_to_string(list_transform(s, lambda x: x || ' --[属于]--> ' || dst), chr(10)) AS path,
'围绕实体的子图摘要：' || array_to_string(list_concat([s[1], dst], s[2:]), '、') || chr(10) || '关系：' || array_to_string(list_transform(s, lambda x: '属于'), '；') AS subgraph FROM f""")
def injection_forms(spark, d):
    made = service.forms(F.col("facts"))
    return _fact_arrays(spark, d).select("dst", *[c.alias(k) for k, c in made.items()])


@query("""WITH f AS (SELECT dst, list_sort(list(src)) AS s FROM edges WHERE type = 'BELONGS_TO' GROUP BY 1), n AS (SELECT n_name AS dst, 'region' || n_regionkey AS category FROM nation),
c AS (SELECT category, len(s) AS n, list_sum(list_transform(s, lambda x: length(x) + length(dst) + 6)) + len(s) - 1 AS t, list_sum(list_transform(s, lambda x: length(x) + length(dst) + 11)) + len(s) - 1 AS p,
  10 + 1 + list_sum(list_transform(s, lambda x: length(x) + 1)) + length(dst) - 1 + 4 + 3 * len(s) - 1 AS g FROM n JOIN f USING (dst)),
a AS (SELECT category, 'triples' AS form, t AS chars, n, 0.0 AS seen FROM c UNION ALL SELECT category, 'path', p, n, 1.0 FROM c UNION ALL SELECT category, 'subgraph', g, n, 0.0 FROM c)
SELECT category, form, count(*) AS questions, round(avg(chars), 2) AS chars, round(avg(n), 4) AS facts, avg(seen)::DOUBLE AS direction_rate, 1.0::DOUBLE AS relation_rate, 0.0::DOUBLE AS empty_rate FROM a GROUP BY 1, 2""")
def injection_sizes(spark, d):
    region = table(spark, d, "nation").select(F.col("n_name").alias("dst"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("category"))
    return service.compared_forms(_fact_arrays(spark, d).join(region, "dst"), "facts", ["category"])


_PARENTS = "c1 AS (SELECT c.c_custkey AS id, c.c_name AS a, p.src AS b, g.src AS c FROM customer c LEFT JOIN edges p ON p.type = 'PARENT_OF' AND p.dst = c.c_name LEFT JOIN edges g ON g.type = 'PARENT_OF' AND g.dst = p.src AND c.c_custkey % 3 > 0)"


def _parents(spark, d) -> DataFrame:
    """Of each customer the edges to a parent and, two of three times, to a grandparent; else to someone else's."""
    p = edges(spark, d, ("PARENT_OF",))
    up = p.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    c = _c(spark, d).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("a")).join(up, "a", "left")
    return c.join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").withColumn("c", F.when(F.col("id") % 3 > 0, F.col("c")))


@query(f"WITH {_PARENTS} SELECT id, CASE WHEN b IS NULL THEN 0.0 WHEN c IS NULL THEN 0.3333 ELSE 0.6667 END::DOUBLE AS three, CASE WHEN b IS NULL THEN 0.0 WHEN c IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS two FROM c1")
def path_completeness(spark, d):
    edge = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    stray = F.struct(F.lit("x").alias("src"), F.lit("y").alias("dst"))
    path = F.when(F.col("b").isNull(), F.array().cast("array<struct<src:string,dst:string>>")).when(F.col("c").isNull(), F.array(edge("a", "b"), stray)).otherwise(F.array(edge("a", "b"), edge("b", "c")))
    return _parents(spark, d).select("id", service.path_completeness(path, F.lit(3)).alias("three"), service.path_completeness(path, F.lit(2)).alias("two"))


@query(f"""WITH {_PARENTS}, k AS (SELECT id, b IS NOT NULL AS hit, CASE WHEN b IS NULL THEN 0 WHEN c IS NULL THEN 1 ELSE 2 END AS n, ['父亲', '妻子', '', '关系'][1 + id % 4] AS relation FROM c1)
SELECT id, CASE WHEN n = 0 THEN 0.5 * hit::INT ELSE (hit::INT + CASE WHEN relation IN ('', '关系', '父亲') OR (relation = '妻子' AND n = 2) THEN 1.0 ELSE 0.5 END) / 2 END::DOUBLE AS sufficiency FROM k""")
def evidence_sufficiency(spark, d):
    none = F.array().cast("array<string>")
    kinds = F.when(F.col("b").isNull(), none).when(F.col("c").isNull(), F.array(F.lit("PARENT_OF"))).otherwise(F.array(F.lit("PARENT_OF"), F.lit("SPOUSE_OF")))
    relation = F.get(F.array(*[F.lit(x) for x in ("父亲", "妻子", "", "关系")]), (F.col("id") % 4).cast("int"))
    return _parents(spark, d).select("id", service.evidence_sufficiency(F.col("b").isNotNull(), kinds, relation).alias("sufficiency"))


@query("SELECT CASE WHEN source LIKE 'src1%' THEN '武功' WHEN source LIKE 'src2%' THEN '门派' ELSE '人物' END AS category, count(*) AS n FROM documents GROUP BY 1", False)
def question_categories(spark, d):
    kind = F.when(F.col("source").like("src1%"), "传承").when(F.col("source").like("src2%"), "帮派").otherwise("x")
    return table(spark, d, "documents").groupBy(answer.category(kind).alias("category")).agg(F.count("*").alias("n"))


# Retrieval methods


def _mentions(spark, d):
    """Chunks and the sects that their source stands for."""
    n = table(spark, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("book"), F.col("n_name").alias("name"))
    return chunks(spark, d).join(n, "book").select("chunk_id", "name")


@query(f"""WITH {similar_sql("released license", 5)}, m AS (SELECT chunk_id, n_name AS name FROM chunks JOIN nation ON book = 'src' || n_nationkey WHERE chunk_id IN (SELECT chunk_id FROM best)),
b AS (SELECT src AS name, type, dst AS other FROM edges WHERE type IN ('FOUNDER_OF', 'LOCATED_IN') UNION ALL SELECT dst, type, src FROM edges WHERE type IN ('FOUNDER_OF', 'LOCATED_IN')), f AS (SELECT DISTINCT chunk_id, m.name, type, other FROM m JOIN b USING (name)),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY type, name, other) AS k FROM f QUALIFY k <= 12) SELECT chunk_id, name, type, other FROM r ORDER BY chunk_id, k LIMIT 10""")
def method_search_and_expand(spark, d):
    return service.search_and_expand(chunks(spark, d), _mentions(spark, d), edges(spark, d, ("FOUNDER_OF", "LOCATED_IN")), "released license", 5)


@query("""WITH a AS (SELECT src, dst FROM edges WHERE type = 'MASTER_OF'), s AS (SELECT min(dst) AS d FROM a) SELECT s.d || ',' || a.src AS names FROM s JOIN a ON a.dst = s.d WHERE a.src <> s.d ORDER BY 1 LIMIT 5""")
def method_master_chain(spark, d):
    e = edges(spark, d, ("MASTER_OF",))
    return answer.master_chain(e, e.agg(F.min("dst")).first()[0], 1, "in").select(F.array_join("names", ",").alias("names"))


@query("""WITH s AS (SELECT min(n_name) AS n FROM nation) SELECT m.dst AS name, count(DISTINCT b.src) AS n_chunks FROM edges b JOIN edges m ON b.type = 'BELONGS_TO' AND m.type = 'MASTERS' AND b.src = m.src JOIN s ON b.dst = s.n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def method_sect_arts(spark, d):
    first = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return answer.sect_agg(edges(spark, d, ("BELONGS_TO", "MASTERS")), first, "arts")


@query("""SELECT m.src, d.dst, 'extracted' AS confidence FROM edges m JOIN edges d ON m.type = 'MASTERS' AND m.dst = 'Part#5' AND d.type = 'MASTER_OF' AND d.src = m.src AND d.src <> d.dst WHERE d.dst IN (SELECT src FROM edges WHERE type = 'MASTERS' AND dst = 'Part#5') ORDER BY 1, 2 LIMIT 5""")
def method_art_lineage(spark, d):
    return answer.art_lineage(edges(spark, d, ("MASTERS", "MASTER_OF", "BRANCHED_FROM")), "Part#5", "lineage")


@query()
def routed_answers(spark, d):
    e = edges(spark, d, ("BELONGS_TO", "FOUNDER_OF", "PARENT_OF", "SPOUSE_OF", "MASTER_OF", "MASTERS", "BRANCHED_FROM"))
    engine = service.Engine(spark, nodes(spark, d), e, chunks(spark, d))
    asked = ["Customer#000000004的父亲是谁", "NATION_3有哪些成员", "the license", "Part#5的传承"]
    replies = [engine.ask(q, k=3) for q in asked]
    return spark.createDataFrame([(r.question, r.intent, r.method, r.status, r.text, r.fallback_from) for r in replies], "question string, intent string, method string, status string, text string, fallback_from string")


@query("SELECT status, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'retryable' WHEN doc_id % 10 = 1 THEN 'fatal' ELSE 'ok' END AS status, n_chars FROM documents) GROUP BY 1", False)
def ingest_run_stats(spark, d):
    status = F.when(F.col("doc_id") % 10 == 0, "retryable").when(F.col("doc_id") % 10 == 1, "fatal").otherwise("ok")
    return evaluate.run_stats(table(spark, d, "documents").select(status.alias("status"), "n_chars"))


@query(f"SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes WHERE label <> '{ART}' GROUP BY 2 UNION ALL SELECT 'type', 'LOCATED_IN', count(*) FROM edges WHERE type = 'LOCATED_IN'")
def scoped_inventory(spark, d):
    return stats.inventory(nodes(spark, d).where(F.col("label") != ART), edges(spark, d, ("LOCATED_IN",)))
