"""Queries of the engine by name, each with the SQL that states the same on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import sequential, text
from weftgraph.operators import align, answer, evaluate, extract, graph, match, stats, store, vectors
from weftgraph.plans import questions, texts, upkeep  # noqa: F401  their queries join the registry
from weftgraph.plans.projection import chunks, edges, nodes, shared_folder, table
from weftgraph.plans.registry import oracle_sql, queries, query
from weftgraph.schema import ART, NOISE_NAMES, PERSON, RELATIONS, SECT, ontology
from weftgraph.sources import files
from weftgraph.streaming import ingest

__all__ = ["oracle_sql", "queries"]

# Scans and statistics


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash, length(text) AS n FROM documents", False)
def chunk_row_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"), F.length("text").cast("long").alias("n"))


@query("SELECT label, coalesce(era, '<null>') AS era, count(*) AS n FROM nodes GROUP BY 1, 2")
def graph_nodes_by_label_era(spark, d):
    return stats.nodes_by_era(nodes(spark, d))


@query("SELECT type, count(*) AS n, count(*) FILTER (WHERE len(chunk_ids) = 0) AS n_bare, count(*) FILTER (WHERE src = dst) AS n_loops FROM edges GROUP BY 1")
def graph_edges_by_type_evidence(spark, d):
    return stats.edges_by_type(edges(spark, d))


@query("SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY 2")
def graph_inventory(spark, d):
    return stats.inventory(nodes(spark, d), edges(spark, d))


@query("""WITH s AS (SELECT name FROM nodes WHERE era IN ('BUILDING', 'MACHINERY'))
SELECT type, src, dst FROM edges WHERE type IN ('PARENT_OF', 'SPOUSE_OF') AND src IN (FROM s) AND dst IN (FROM s)""")
def era_scoped_graph(spark, d):
    e = edges(spark, d, ("PARENT_OF", "SPOUSE_OF"))
    return match.scoped_edges(nodes(spark, d), e, ["BUILDING", "MACHINERY"]).select("type", "src", "dst")


@query("""SELECT DISTINCT type, src, dst FROM edges WHERE (src = 'Customer#000000007' OR dst = 'Customer#000000007') AND type IN ('PARENT_OF', 'SPOUSE_OF', 'BELONGS_TO')
AND (src IN (SELECT name FROM nodes WHERE era = 'MACHINERY') OR dst IN (SELECT name FROM nodes WHERE era = 'MACHINERY'))""")
def era_any_endpoint_neighbors(spark, d):
    e = edges(spark, d, ("PARENT_OF", "SPOUSE_OF", "BELONGS_TO"))
    return match.neighbours_any_era(nodes(spark, d), e, "Customer#000000007", "MACHINERY").select("type", "src", "dst").distinct()


_CANDIDATES = f"""
SELECT o_orderkey AS id, ['MASTER_OF', 'BELONGS_TO', 'LOVES', 'LOCATED_IN', 'SPOUSE_OF'][1 + o_orderkey % 5] AS type, '{PERSON}' AS src_label, o_custkey::VARCHAR AS src,
       CASE WHEN o_orderkey % 2 = 0 THEN '{PERSON}' ELSE '{SECT}' END AS dst_label, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE (o_orderkey % 100)::VARCHAR END AS dst FROM orders"""
_ALLOWED = " ".join(f"WHEN '{t}' THEN [{', '.join(repr(x) for x in r)}]" for t, _, r, _ in RELATIONS)
_STARTS = " ".join(f"WHEN '{t}' THEN [{', '.join(repr(x) for x in a)}]" for t, a, _, _ in RELATIONS)


@query(f"""WITH c AS ({_CANDIDATES}), r AS (SELECT *, CASE type {_STARTS} END AS a, CASE type {_ALLOWED} END AS b FROM c)
SELECT id, CASE WHEN a IS NULL THEN 'unknown_type' WHEN src = '' THEN 'no_source' WHEN dst = '' THEN 'no_target' WHEN src = dst THEN 'self_loop'
  WHEN NOT list_contains(a, src_label) THEN 'bad_domain' WHEN NOT list_contains(b, dst_label) THEN 'bad_range' END AS reason FROM r""")
def ontology_violations(spark, d):
    o = table(spark, d, "orders")
    kinds = F.array(*[F.lit(x) for x in ("MASTER_OF", "BELONGS_TO", "LOVES", "LOCATED_IN", "SPOUSE_OF")])
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("type"), F.lit(PERSON).alias("src_label"), F.col("o_custkey").cast("string").alias("src"),
        F.when(F.col("o_orderkey") % 2 == 0, PERSON).otherwise(SECT).alias("dst_label"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise((F.col("o_orderkey") % 100).cast("string")).alias("dst"),
    )
    return match.check_relations(rows, ontology(spark)).select("id", "reason")


# Pattern joins


@query("SELECT src AS name, len(chunk_ids)::INT AS n FROM edges WHERE type = 'BELONGS_TO' AND dst = (SELECT min(n_name) FROM nation)")
def sect_members(spark, d):
    first = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return match.members(edges(spark, d, ("BELONGS_TO",)), "BELONGS_TO", first).select("name", F.size("chunk_ids").alias("n"))


@query("SELECT dst AS sect, src AS founder FROM edges WHERE type = 'FOUNDER_OF'")
def sect_founders(spark, d):
    return edges(spark, d, ("FOUNDER_OF",)).select(F.col("dst").alias("sect"), F.col("src").alias("founder"))


@query("""WITH k AS (SELECT DISTINCT b.dst AS sect, m.dst AS art, b.src AS person FROM edges b JOIN edges m ON b.type = 'BELONGS_TO' AND m.type = 'MASTERS' AND b.src = m.src),
g AS (SELECT sect, art, list_sort(list(person)) AS p FROM k GROUP BY 1, 2)
SELECT sect, art, len(p)::INT AS n_persons, array_to_string(p[1:20], ',') AS persons FROM g""")
def sect_arts_grouped(spark, d):
    return match.arts_grouped(match.sect_arts(edges(spark, d, ("BELONGS_TO", "MASTERS"))))


@query("SELECT src AS name, array_to_string(chunk_ids, ',') AS ids FROM edges WHERE type = 'MASTERS' AND dst = 'Part#5'")
def art_practitioners(spark, d):
    return match.members(edges(spark, d, ("MASTERS",)), "MASTERS", "Part#5").select("name", F.array_join("chunk_ids", ",").alias("ids"))


@query("SELECT src, dst, 'inferred' AS confidence FROM edges WHERE type = 'BRANCHED_FROM' AND src = 'Part#77'")
def art_origin(spark, d):
    return answer.art_lineage(edges(spark, d, ("BRANCHED_FROM", "MASTERS", "MASTER_OF")), "Part#77", "origin")


@query("""SELECT m.dst AS art, count(*) AS n_pairs, count(DISTINCT t.src) AS n_masters, min(t.dst) AS first_disciple FROM edges m JOIN edges t ON m.type = 'MASTERS' AND t.type = 'MASTER_OF' AND t.src = m.src AND t.src <> t.dst
WHERE EXISTS (SELECT 1 FROM edges k WHERE k.type = 'MASTERS' AND k.src = t.dst AND k.dst = m.dst) GROUP BY 1""")
def art_lineage_pairs(spark, d):
    pairs = match.lineage(edges(spark, d, ("MASTERS", "MASTER_OF")))
    return pairs.groupBy("art").agg(F.count("*").alias("n_pairs"), F.count_distinct("master").alias("n_masters"), F.min("disciple").alias("first_disciple"))


_MENTIONS = "SELECT DISTINCT 'order::' || o_orderkey AS chunk_id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey"


def _mentions(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.concat(F.lit("order::"), F.col("o_orderkey").cast("string")).alias("chunk_id"), F.col("c_name").alias("name")).distinct()


@query(f"""WITH m AS ({_MENTIONS}), b AS (SELECT src AS name, type, dst AS other FROM edges WHERE type IN ('PARENT_OF', 'SPOUSE_OF', 'BELONGS_TO') UNION ALL SELECT dst, type, src FROM edges WHERE type IN ('PARENT_OF', 'SPOUSE_OF', 'BELONGS_TO')),
f AS (SELECT DISTINCT chunk_id, m.name, type, other FROM m JOIN b USING (name))
SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY type, name, other)::INT AS rank FROM f QUALIFY rank <= 12""")
def chunk_entity_expansion(spark, d):
    return match.expand_mentions(_mentions(spark, d), edges(spark, d, ("PARENT_OF", "SPOUSE_OF", "BELONGS_TO")), 12)


@query("""WITH p AS (SELECT src, dst FROM edges WHERE type = 'PARENT_OF'), t AS (SELECT min(src) AS s FROM p),
two AS (SELECT a.src AS a, a.dst AS b, b.dst AS c FROM t JOIN p a ON a.src = t.s JOIN p b ON b.src = a.dst)
SELECT 2 AS hops, a || ',' || b || ',' || c AS names FROM two UNION ALL SELECT 3, a || ',' || b || ',' || c || ',' || p.dst FROM two JOIN p ON p.src = c""")
def master_chain_fixed_hops(spark, d):
    e = edges(spark, d, ("PARENT_OF",))
    start = e.agg(F.min("src")).first()[0]
    parts = [match.fixed_hops(e, "PARENT_OF", start, h).select(F.lit(h).alias("hops"), F.array_join("names", ",").alias("names")) for h in (2, 3)]
    return parts[0].unionByName(parts[1])


@query("""WITH s AS (SELECT s.dst AS sp FROM edges s WHERE s.type = 'SPOUSE_OF' AND s.src = 'Customer#000000009')
SELECT 'Customer#000000009,' || sp || ',' || p.src AS names FROM s JOIN edges p ON p.type = 'PARENT_OF' AND p.dst = sp WHERE p.src <> 'Customer#000000009'""")
def plan_two_step_spouse_parent(spark, d):
    e = edges(spark, d, ("SPOUSE_OF", "PARENT_OF"))
    return match.traverse(e, "Customer#000000009", [("SPOUSE_OF", "both"), ("PARENT_OF", "in")]).select(F.array_join("names", ",").alias("names"))


@query("""WITH r AS (SELECT type, src, dst FROM edges WHERE type IN ('BELONGS_TO', 'PARENT_OF', 'SPOUSE_OF')), n AS (SELECT src AS name FROM r UNION ALL SELECT dst FROM r),
t AS (SELECT name, count(*) AS degree FROM n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40)
SELECT r.src, r.type, r.dst, a.degree + b.degree AS weight FROM r JOIN t a ON a.name = r.src JOIN t b ON b.name = r.dst ORDER BY weight DESC, src, type, dst LIMIT 80""")
def degree_capped_subgraph(spark, d):
    return match.capped_subgraph(edges(spark, d, ("BELONGS_TO", "PARENT_OF", "SPOUSE_OF")))


# Graph algorithms


def _family(spark, d):
    return edges(spark, d, ("PARENT_OF", "SPOUSE_OF"))


_NEAR = "near AS (SELECT src AS a, dst AS b FROM edges WHERE type IN ('PARENT_OF', 'SPOUSE_OF') AND src <> dst UNION SELECT dst, src FROM edges WHERE type IN ('PARENT_OF', 'SPOUSE_OF') AND src <> dst)"


@query(f"""WITH {_NEAR}, reach(name, distance) AS (SELECT 'Customer#000000001', 0 UNION SELECT b, distance + 1 FROM reach JOIN near ON a = name WHERE distance < 4)
SELECT name, min(distance)::INT AS distance FROM reach GROUP BY 1""")
def bfs_distances(spark, d):
    return graph.bfs(_family(spark, d), "Customer#000000001", 4).select("name", "distance")


@query(f"""WITH {_NEAR}, walk(name, distance, path) AS (SELECT 'Customer#000000003', 0, ['Customer#000000003'] UNION ALL SELECT b, distance + 1, list_append(path, b) FROM walk JOIN near ON a = name WHERE distance < 5 AND NOT list_contains(path, b)),
w AS (SELECT * FROM walk WHERE name = 'Customer#000000012')
SELECT distance::INT AS distance, min(array_to_string(path, ',')) AS path FROM w WHERE distance = (SELECT min(distance) FROM w) GROUP BY 1""")
def shortest_path_pair(spark, d):
    return graph.shortest_path(_family(spark, d), "Customer#000000003", "Customer#000000012", 5).select("distance", F.array_join("path", ",").alias("path"))


@query("""WITH p AS (SELECT name FROM nodes), near AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), g AS (SELECT a, count(*) AS degree FROM near GROUP BY 1)
SELECT p.name, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) / greatest((SELECT count(*) FROM p) - 1, 1), 6) AS centrality FROM p LEFT JOIN g ON g.a = p.name""")
def degree_centrality(spark, d):
    return graph.degree_centrality(nodes(spark, d).select("name"), edges(spark, d))


_ROUNDS = 10


def _pagerank_sql() -> str:
    steps = [f"WITH {_NEAR}, v AS (SELECT c_name AS name FROM customer), k AS (SELECT a, count(*) AS out FROM near GROUP BY 1), c AS (SELECT count(*) AS n FROM v), r0 AS MATERIALIZED (SELECT name, 1.0::DOUBLE / n AS rank FROM v, c)"]
    for i in range(_ROUNDS):
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT v.name, 0.15 / c.n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE name NOT IN (SELECT a FROM k)) / c.n + 0.85 * coalesce(s.got, 0) AS rank
FROM v CROSS JOIN c LEFT JOIN (SELECT b, sum(rank / out) AS got FROM near JOIN r{i} ON name = near.a JOIN k ON k.a = near.a GROUP BY 1) s ON s.b = v.name)""")
    return ", ".join(steps) + f" SELECT name, round(rank, 8) AS rank FROM r{_ROUNDS}"


@query(_pagerank_sql())
def pagerank_10_iter(spark, d):
    return graph.pagerank(table(spark, d, "customer").select(F.col("c_name").alias("name")), _family(spark, d), rounds=_ROUNDS, tolerance=None)


@query()
def communities_louvain(spark, d):
    return graph.louvain(_family(spark, d))


@query()
def communities_parallel(spark, d):
    return graph.communities(_family(spark, d))


def _propagation_sql(rounds: int) -> str:
    steps = [f"WITH {_NEAR}, l0 AS MATERIALIZED (SELECT c_name AS name, c_name AS label FROM customer)"]
    for i in range(rounds):
        steps.append(f"""v{i} AS (SELECT near.a AS name, l.label, count(*) AS n FROM near JOIN l{i} l ON l.name = near.b GROUP BY 1, 2), w{i} AS (SELECT name, arg_min(label, (-n, label)) AS label FROM v{i} GROUP BY 1),
l{i + 1} AS MATERIALIZED (SELECT l.name, coalesce(w.label, l.label) AS label FROM l{i} l LEFT JOIN w{i} w USING (name))""")
    return ", ".join(steps) + f" SELECT name, label FROM l{rounds}"


@query(_propagation_sql(5))
def label_propagation(spark, d):
    return graph.label_propagation(table(spark, d, "customer").select(F.col("c_name").alias("name")), _family(spark, d))


@query("""SELECT name, 1::INT AS distance, false AS blood FROM (SELECT dst AS name FROM edges WHERE type IN ('PARENT_OF', 'SPOUSE_OF') AND src = 'Customer#000000003' UNION SELECT src FROM edges WHERE type IN ('PARENT_OF', 'SPOUSE_OF') AND dst = 'Customer#000000003')
JOIN customer ON c_name = name WHERE c_mktsegment <> (SELECT c_mktsegment FROM customer WHERE c_name = 'Customer#000000003') ORDER BY name LIMIT 5""")
def cross_era_relatives(spark, d):
    return answer.cross_novel(nodes(spark, d), _family(spark, d), "Customer#000000003", 5, 1)


# Merges and alignment


def _node_rows(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("ord"), F.lit(PERSON).alias("label"), F.concat(F.lit("user"), (F.col("user_id") % 50).cast("string")).alias("name"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("era"),
        F.concat(F.lit("book"), (F.col("event_id") % 4).cast("string")).alias("book"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("props")).alias("description"),
        F.lit(None).cast("string").alias("location"), F.when(F.col("event_id") % 11 == 0, F.col("event_type")).alias("art_type"),
    )


_NODE_ROWS = f"""SELECT event_id AS ord, '{PERSON}' AS label, 'user' || (user_id % 50) AS name, CASE WHEN event_id % 3 > 0 THEN event_type END AS era, 'book' || (event_id % 4) AS book,
CASE WHEN event_id % 5 = 0 THEN '' ELSE props END AS description, CASE WHEN event_id % 11 = 0 THEN event_type END AS art_type FROM events"""


@query(f"""WITH r AS ({_NODE_ROWS}), e AS (SELECT label, name, era, min(ord) AS o FROM r WHERE era <> '' GROUP BY ALL), b AS (SELECT label, name, book, min(ord) AS o FROM r GROUP BY ALL)
SELECT label, name, arg_min(era, ord) FILTER (WHERE era <> '') AS era, arg_min(art_type, ord) FILTER (WHERE art_type <> '') AS art_type,
  (SELECT d.description FROM r d WHERE d.label = r.label AND d.name = r.name AND length(d.description) > 0 ORDER BY length(d.description) DESC, d.ord LIMIT 1) AS description,
  (SELECT string_agg(era, ',' ORDER BY o) FROM e WHERE e.label = r.label AND e.name = r.name) AS eras, (SELECT string_agg(book, ',' ORDER BY o) FROM b WHERE b.label = r.label AND b.name = r.name) AS books
FROM r GROUP BY label, name""")
def node_upsert(spark, d):
    out = store.merge_nodes(_node_rows(spark, d))
    return out.select("label", "name", "era", "art_type", "description", F.array_join("eras", ",").alias("eras"), F.array_join("books", ",").alias("books"))


@query("""WITH r AS (SELECT event_id AS ord, 'user' || (user_id % 50) AS src, event_type AS dst, 'c' || (event_id % 20) AS chunk_id FROM events), c AS (SELECT src, dst, chunk_id, min(ord) AS o FROM r GROUP BY ALL)
SELECT src, dst, arg_min(chunk_id, o) AS chunk_id, string_agg(chunk_id, ',' ORDER BY o) AS chunk_ids FROM c GROUP BY 1, 2""")
def edge_upsert(spark, d):
    none = F.lit(None).cast("string")
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("ord"), F.lit("ENEMY_OF").alias("type"), F.lit(PERSON).alias("src_label"), F.concat(F.lit("user"), (F.col("user_id") % 50).cast("string")).alias("src"), F.lit(PERSON).alias("dst_label"),
        F.col("event_type").alias("dst"), F.concat(F.lit("c"), (F.col("event_id") % 20).cast("string")).alias("chunk_id"), none.alias("snippet"), none.alias("era"), none.alias("book"),
    )
    return store.merge_edges(rows).select("src", "dst", "chunk_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("SELECT 'c' || (event_id % 100) AS chunk_id, arg_max(event_type, event_id) AS text, arg_max(value, event_id) FILTER (WHERE event_id % 3 = 0) AS embedding FROM events GROUP BY 1")
def chunk_upsert(spark, d):
    e = table(spark, d, "events")
    return store.merge_chunks(e.select(F.col("event_id").alias("ord"), F.concat(F.lit("c"), (F.col("event_id") % 100).cast("string")).alias("chunk_id"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("embedding")))


@query(f"SELECT chunk_id, name FROM ({_MENTIONS})")
def mention_merge(spark, d):
    m = _mentions(spark, d)
    return store.merge_mentions(m.unionByName(m))


# Of fifty customers in a row the first 44 stand for the next one, three for each other in a ring, and one leads into that.
_DECISIONS = "SELECT c_name AS alias, 'Customer#' || lpad((CASE c_custkey % 50 WHEN 47 THEN c_custkey - 2 WHEN 48 THEN c_custkey - 1 ELSE c_custkey + 1 END)::VARCHAR, 9, '0') AS canonical FROM customer WHERE c_custkey % 50 < 44 OR c_custkey % 50 IN (45, 46, 47, 48)"


def _decisions(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 50 < 44 OR c_custkey % 50 IN (45, 46, 47, 48)")
    to = F.expr("CASE c_custkey % 50 WHEN 47 THEN c_custkey - 2 WHEN 48 THEN c_custkey - 1 ELSE c_custkey + 1 END")
    return c.select(F.col("c_name").alias("alias"), F.concat(F.lit("Customer#"), F.lpad(to.cast("string"), 9, "0")).alias("canonical"))


_FLAT = f"m AS ({_DECISIONS}), walk(alias, canonical, path) AS (SELECT alias, canonical, [alias] FROM m UNION ALL SELECT w.alias, m.canonical, list_append(path, m.alias) FROM walk w JOIN m ON m.alias = w.canonical WHERE NOT list_contains(path, m.alias)), flat AS (SELECT w.alias, w.canonical, len(path) > 1 AS chained FROM walk w WHERE w.canonical NOT IN (SELECT alias FROM m))"


@query(f"WITH {_FLAT} SELECT alias, canonical, chained FROM flat")
def alias_chain_flatten(spark, d):
    return store.flatten_aliases(_decisions(spark, d))


@query(f"""WITH {_FLAT}, e AS (SELECT type, coalesce(a.canonical, src) AS src, coalesce(b.canonical, dst) AS dst, a.alias IS NOT NULL OR b.alias IS NOT NULL AS moved
FROM edges LEFT JOIN flat a ON a.alias = src LEFT JOIN flat b ON b.alias = dst WHERE type IN ('PARENT_OF', 'SPOUSE_OF', 'BELONGS_TO'))
SELECT type, src, dst, count(*) FILTER (WHERE moved) AS moved, count(*) - 1 AS merged FROM e WHERE NOT (moved AND src = dst) GROUP BY 1, 2, 3""")
def alias_rewrite_edges(spark, d):
    e = edges(spark, d, ("PARENT_OF", "SPOUSE_OF", "BELONGS_TO")).select("type", "src", "dst")
    return store.rewrite_edges(e, store.flatten_aliases(_decisions(spark, d)))


_ALIASES = f"SELECT p_type AS alias, '{ART}' AS label, p_brand AS canonical FROM part"


def _aliases(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("alias"), F.lit(ART).alias("label"), F.col("p_brand").alias("canonical"))


@query(f"WITH a AS ({_ALIASES}) SELECT alias, label, string_agg(DISTINCT canonical, ',' ORDER BY canonical) AS canonicals FROM a GROUP BY 1, 2 HAVING count(DISTINCT canonical) > 1")
def alias_conflicts(spark, d):
    return stats.conflicts(_aliases(spark, d))


@query(f"""WITH a AS (SELECT p_name AS alias, '{ART}' AS label, 'Part#' || (p_size % 70) AS canonical FROM part)
SELECT alias, label, max(canonical) AS canonical FROM a GROUP BY 1, 2 HAVING count(DISTINCT canonical) = 1 AND max(canonical) IN (SELECT name FROM nodes WHERE label = '{ART}')""")
def alias_unique_map(spark, d):
    a = table(spark, d, "part").select(F.col("p_name").alias("alias"), F.lit(ART).alias("label"), F.concat(F.lit("Part#"), (F.col("p_size") % 70).cast("string")).alias("canonical"))
    return stats.unique_aliases(a, nodes(spark, d))


_ODD = f"SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '师父' WHEN 1 THEN ' ' WHEN 2 THEN '雕' WHEN 3 THEN '那人' ELSE c_name END AS name FROM customer"


@query(f"WITH o AS ({_ODD}) SELECT id, length(trim(name)) <= 1 OR name IN ({', '.join(repr(n) for n in NOISE_NAMES)}) AS noise FROM o")
def noise_filter(spark, d):
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, "师父").when(k == 1, " ").when(k == 2, "雕").when(k == 3, "那人").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.is_noise(name).alias("noise"))


_TITLED = f"SELECT '{PERSON}' AS label, c_mktsegment AS era, 'p' || (c_custkey // 3) || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '大侠' ELSE '真人' END AS name FROM customer"


@query(f"""WITH t AS ({_TITLED}), k AS (SELECT *, CASE WHEN name LIKE '%大侠' OR name LIKE '%真人' THEN left(name, length(name) - 2) ELSE name END AS key FROM t),
g AS (SELECT label, era, key, list(DISTINCT name) AS names, arg_min(name, (-length(name), name)) AS canonical FROM k GROUP BY 1, 2, 3), u AS (SELECT label, era, canonical, unnest(names) AS alias FROM g WHERE len(names) > 1)
SELECT label, era, alias, canonical FROM u WHERE alias <> canonical""")
def rule_layer_groups(spark, d):
    c = table(spark, d, "customer")
    title = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "大侠").otherwise("真人")
    return align.rule_groups(c.select(F.lit(PERSON).alias("label"), F.col("c_mktsegment").alias("era"), F.concat(F.lit("p"), F.expr("c_custkey div 3").cast("string"), title).alias("name")))


@query()
def similar_name_pairs(spark, d):
    names = table(spark, d, "part").select(F.lit(ART).alias("label"), F.col("p_name").alias("name"))
    return align.similar_pairs(names)


@query("SELECT 'c' || event_id AS chunk_id FROM events WHERE event_id % 4 <> 0 OR event_id % 8 = 0", False)
def resume_filter(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chunk_id"), F.col("event_type").alias("content_hash"), "event_id")
    done = e.where("event_id % 4 = 0").select("chunk_id", F.when(F.col("event_id") % 8 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return store.pending(e.drop("event_id"), done).select("chunk_id")


# Vectors and text


def _query_vector(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


_SCORES = "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings"


@query(f"SELECT vec_id, label, score FROM ({_SCORES}) ORDER BY score DESC, vec_id LIMIT 10", False)
def vector_topk(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), _query_vector(spark, d), 10)


@query(f"SELECT * FROM (SELECT vec_id, label, score FROM ({_SCORES}) ORDER BY score DESC, vec_id LIMIT 10) WHERE label IN (1, 2, 3)", False)
def vector_topk_postfilter(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), _query_vector(spark, d), 10).where(F.col("label").isin(1, 2, 3))


_TOKENS = r"regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]|[a-zA-Z0-9_]+')"


@query(f"SELECT doc_id, slot, w AS weight FROM {questions.hashed_sql('SELECT doc_id, text FROM documents', 'doc_id')}", False)
def hash_embedding_sparse(spark, d):
    return vectors.hash_embedding(table(spark, d, "documents"), "doc_id", "text")


@query(rf"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), c AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t), h AS (SELECT doc_id, len(t) AS size, unnest(t) AS tok FROM t),
f AS (SELECT doc_id, size, tok, count(*) AS tf FROM h WHERE tok IN ('the', 'license', 'for') GROUP BY ALL), df AS (SELECT tok, count(*) AS df FROM f GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 4) AS score FROM f JOIN df USING (tok) CROSS JOIN c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", False)
def text_bm25_topk(spark, d):
    return vectors.bm25(table(spark, d, "documents"), "doc_id", "text", ["the", "license", "for"])


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;\n]*[。！？!?；;\n]|[^。！？!?；;\n]+$'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::INT AS n_sentences, len(list_filter(s, lambda x: contains(x, 'the') AND contains(x, 'and')))::INT AS n_shared FROM s""", False)
def sentence_cooccurrence(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences(t)).alias("n_sentences"), F.size(text.shared_sentences(t, F.lit("the"), F.lit("and"))).alias("n_shared"))


@query(r"""WITH e AS (SELECT doc_id, d.text, doc_id % 5 AS k, CASE doc_id % 5 WHEN 0 THEN b.text WHEN 1 THEN '甲 是乙的师父' WHEN 2 THEN '甲杀乙' ELSE '' END AS evidence FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, CASE k WHEN 0 THEN CASE WHEN contains(regexp_replace(text, '[\s\p{Z}]+', '', 'g'), regexp_replace(evidence, '[\s\p{Z}]+', '', 'g')) THEN 'no_kinship' ELSE 'not_in_text' END WHEN 2 THEN 'not_in_text' WHEN 3 THEN 'no_shared_sentence' WHEN 4 THEN 'no_kinship_sentence' ELSE 'no_kinship' END AS reason, NULL::VARCHAR AS adopted FROM e
UNION ALL SELECT doc_id + 1000000000, NULL, '甲是乙的父亲。' FROM documents""", False)
def evidence_gate(spark, d):
    b = table(spark, d, "benchmark")
    n = b.count()
    k = F.col("doc_id") % 5
    rows = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % n).join(b.select("item_id", F.col("text").alias("passage")), "item_id")
    said = F.when(k == 0, F.col("passage")).when(k == 1, "甲 是乙的师父").when(k == 2, "甲杀乙").otherwise("")
    body = F.when(k == 1, F.concat(F.lit("甲是乙的师父。\n"), "text")).when(k == 3, F.concat(F.lit("甲来。乙去。\n"), "text")).when(k == 4, F.concat(F.lit("甲见乙。\n"), "text")).otherwise(F.col("text"))
    judged = rows.select("doc_id", said.alias("said"), body.alias("body"))
    whole = table(spark, d, "documents").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.lit("").alias("said"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n甲见乙。甲是乙的父亲。")).alias("body"))
    judged = judged.unionByName(whole)
    reason, adopted = text.evidence_gate(F.lit("PARENT_OF"), F.lit("甲"), F.lit("乙"), F.col("said"), F.col("body"))
    return judged.select("doc_id", reason.alias("reason"), adopted.alias("adopted"))


@query()
def doc_chunks(spark, d):
    c = table(spark, d, "documents").withColumn("s", F.explode(sequential.spans_of(F.col("text"))))
    piece = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return c.select("doc_id", "s.start", "s.end", text.content_hash(piece).alias("content_hash"))


@query("""WITH w AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), o AS (SELECT doc_id, min(k) AS k, line FROM w GROUP BY doc_id, line),
u AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM o),
f AS (SELECT *, max((r > 1 AND used + length(line) > 800)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS broken FROM u)
SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM f WHERE broken = 0 GROUP BY 1""", False)
def context_budget(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return stats.within_budget(lines, "doc_id", "k", "line", 800).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query("""WITH e AS (SELECT src, type, dst, chunk_ids[1] AS chunk_id FROM edges WHERE type = 'MASTER_OF')
SELECT e.src, e.type, e.dst, e.chunk_id, CASE length(e.dst) % 2 WHEN 0 THEN 'URGENT' ELSE right(e.chunk_id, 1) || '-' END AS snippet, o.o_orderkey IS NOT NULL AS chunk_exists,
  coalesce(contains(o.o_orderpriority || ' ' || right(e.chunk_id, 1) || '-', CASE length(e.dst) % 2 WHEN 0 THEN 'URGENT' ELSE right(e.chunk_id, 1) || '-' END), false) AS found
FROM e LEFT JOIN orders o ON o.o_orderkey::VARCHAR = e.chunk_id AND o.o_orderkey % 7 > 0""")
def snippet_verification(spark, d):
    said = F.when(F.length("dst") % 2 == 0, "URGENT").otherwise(F.concat(F.substring(F.get("chunk_ids", F.lit(0)), -1, 1), F.lit("-")))
    e = edges(spark, d, ("MASTER_OF",)).withColumn("snippets", F.array(said))
    o = table(spark, d, "orders").where("o_orderkey % 7 > 0")
    key = F.col("o_orderkey").cast("string")
    return evaluate.snippets_found(e, o.select(key.alias("chunk_id"), F.concat("o_orderpriority", F.lit(" "), F.substring(key, -1, 1), F.lit("-")).alias("text")))


# Questions and evaluation

# Question forms for the routing queries.
_FORMS = ("%s的父亲是谁", "%s的师父是谁", "%s精通什么", "%s属于哪个门派", "%s和别人谁厉害", "%s创立了什么", "%s是谁")


@query("""SELECT CASE c_custkey % 7 WHEN 0 THEN 'person_relation' WHEN 1 THEN 'person' WHEN 5 THEN 'sect' ELSE 'general' END AS intent,
CASE c_custkey % 7 WHEN 0 THEN 'person_relation' WHEN 1 THEN 'master_chain' WHEN 5 THEN 'sect_agg' ELSE 'vector' END AS method, count(*) AS n FROM customer GROUP BY 1, 2""", False)
def intent_route_counts(spark, d):
    forms = F.array(*[F.lit(f) for f in _FORMS])
    none = F.array().cast("array<string>")
    q = table(spark, d, "customer").select(F.replace(F.get(forms, (F.col("c_custkey") % 7).cast("int")), F.lit("%s"), F.col("c_name")).alias("question"), F.array("c_name").alias("people"), none.alias("sects"), none.alias("arts"))
    return answer.classify(q).groupBy("intent", "method").agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey, n_name AS sects, 'sect' AS intent, 'sect_agg' AS method FROM customer JOIN nation ON c_nationkey = n_nationkey", False)
def entity_links(spark, d):
    lexicon = [(r["n_name"], r["n_name"], SECT) for r in table(spark, d, "nation").select("n_name").collect()]  # 25 rows
    q = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.col("n_name"), F.lit("的掌门是"), F.col("c_name")).alias("question"))
    linked = q.withColumn("links", sequential.links_of(F.col("question"), lexicon)).select("*", *[c.alias(k) for k, c in answer.by_label().items()])
    return answer.classify(linked).select("c_custkey", F.array_join("sects", ",").alias("sects"), "intent", "method")


@query("SELECT c_custkey, ['SPOUSE_OF:both>PARENT_OF:in', 'MASTER_OF:in>MASTER_OF:in', 'MASTER_OF:in', 'SPOUSE_OF:both>PARENT_OF:in'][1 + c_custkey % 4] AS plan FROM customer", False)
def relation_plans(spark, d):
    forms = F.array(*[F.lit(x) for x in ("%s的岳父是谁", "%s的师父的师父是谁", "%s是谁的徒弟", "%s的妻子的母亲是谁")])
    q = table(spark, d, "customer").select("c_custkey", F.replace(F.get(forms, (F.col("c_custkey") % 4).cast("int")), F.lit("%s"), F.col("c_name")).alias("question"))
    return q.select("c_custkey", F.array_join(F.transform(sequential.plans_of(F.col("question")), lambda s: F.concat_ws(":", s["relation"], s["direction"])), ">").alias("plan"))


_RESULTS = "SELECT lang, source, CASE WHEN doc_id % 10 = 0 THEN 'error' WHEN doc_id % 10 = 1 THEN 'no_context' ELSE 'ok' END AS status, quality = 1 AS hit, n_chars::DOUBLE AS latency FROM documents JOIN labels USING (doc_id)"


def _results(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    status = F.when(F.col("doc_id") % 10 == 0, "error").when(F.col("doc_id") % 10 == 1, "no_context").otherwise("ok")
    return rows.select("lang", "source", status.alias("status"), (F.col("quality") == 1).alias("hit"), F.col("n_chars").cast("double").alias("latency"))


@query(f"""WITH r AS ({_RESULTS}) SELECT lang, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS n_ok, sum(hit::INT)::BIGINT AS hits, round(avg(hit::INT), 4) AS accuracy,
round(avg(hit::INT) FILTER (WHERE status IN ('ok', 'no_context')), 4) AS accuracy_answered, round(count(*) FILTER (WHERE status IN ('ok', 'no_context')) / count(*), 4) AS availability, round(avg(latency) FILTER (WHERE status = 'ok'), 4) AS latency FROM r GROUP BY 1""")
def eval_summary(spark, d):
    return stats.evaluation(_results(spark, d), ["lang"])


@query(f"""WITH r AS ({_RESULTS}) SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'status' END AS dimension, coalesce(lang, source, status) AS value, sum(hit::INT)::BIGINT AS hits, count(*) AS n
FROM r GROUP BY GROUPING SETS ((lang), (source), (status))""")
def routing_grouping_sets(spark, d):
    return stats.routing(_results(spark, d), ["lang", "source", "status"])


@query("SELECT c_custkey AS id, c_custkey % 3 <> 1 AS hit FROM customer", False)
def negation_hit(spark, d):
    c = table(spark, d, "customer")
    said = F.when(F.col("c_custkey") % 3 == 0, "答案是%s。").when(F.col("c_custkey") % 3 == 1, "他不是%s！").otherwise("不是%s，后来查明确实就是%s")
    rows = c.select(F.col("c_custkey").alias("id"), F.replace(said, F.lit("%s"), F.col("c_name")).alias("answer"), F.array("c_name").alias("accepted"))
    return answer.judge(rows).select("id", "hit")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS recall, 1.0::DOUBLE AS precision, CASE WHEN c_custkey % 2 = 0 THEN 0.6667 ELSE 1.0 END::DOUBLE AS f1 FROM customer""", False)
def entity_precision_recall(spark, d):
    c = table(spark, d, "customer")
    expected = F.when(F.col("c_custkey") % 2 == 0, F.array("c_name", F.lit("x"))).otherwise(F.array("c_name"))
    r, p, f = answer.precision_recall(expected, F.array("c_name", "c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), r.alias("recall"), p.alias("precision"), f.alias("f1"))


@query(f"""SELECT src_label || '::' || src AS source, dst_label || '::' || dst AS target, type, array_to_string(chunk_ids, ',') AS chunk_ids, CASE WHEN len(chunk_ids) > 0 THEN 'extracted' ELSE 'inferred' END AS confidence, src || ' -[' || type || ']-> ' || dst AS line
FROM edges WHERE type IN ('FOUNDER_OF', 'LOCATED_IN', 'MASTER_OF')""")
def evidence_bundles(spark, d):
    return answer.bundle(edges(spark, d, ("FOUNDER_OF", "LOCATED_IN", "MASTER_OF")))


@query("""WITH q AS (SELECT item_id, row_number() OVER (ORDER BY part, item_id) AS k FROM (SELECT item_id % 3 AS part, item_id FROM benchmark))
SELECT 'q' || lpad(k::VARCHAR, greatest(3, length(k::VARCHAR))::INT, '0') AS id, item_id FROM q""", False)
def question_sets_merged(spark, d):
    b = table(spark, d, "benchmark").select("item_id")
    return evaluate.numbered([b.where(F.col("item_id") % 3 == k) for k in range(3)], "item_id")


# Ingestion


def _extracted(spark, d):
    c = chunks(spark, d).withColumn("text", F.concat(F.lit("郭靖拜洪七公为师。郭靖是郭啸天的儿子。"), F.col("text")))
    good = '{"entities":[{"name":"郭靖","type":"人物"},{"name":"洪七公","type":"人物"},{"name":"郭啸天","type":"人物"},{"name":"降龙掌","type":"外功"},{"name":"某","type":"人物"}],"relationships":[{"source":"洪七公","target":"郭靖","type":"master_of","evidence":"郭靖拜洪七公为师"},{"source":"郭啸天","target":"郭靖","type":"PARENT_OF"},{"source":"郭靖","target":"降龙掌","type":"SPOUSE_OF"},{"source":"郭靖","target":"杨康","type":"ENEMY_OF"}]}'
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), F.lit(good), F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, "{}").otherwise("no json")
    return extract.parse(c.withColumn("answer", reply))


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' ELSE 'retryable' END AS status, count(*) AS n FROM documents GROUP BY 1", False)
def extraction_status(spark, d):
    return _extracted(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""SELECT unnest(['郭靖', '洪七公', '郭啸天', '降龙掌']) AS name, unnest(['{PERSON}', '{PERSON}', '{PERSON}', '{ART}']) AS type, unnest([NULL, NULL, NULL, '外功']) AS art_type, count(*) AS n FROM documents WHERE doc_id % 3 = 0""", False)
def extraction_entities(spark, d):
    return extract.entities(_extracted(spark, d)).groupBy("name", "type", "art_type").agg(F.count("*").alias("n"))


@query("""SELECT unnest(['MASTER_OF', 'PARENT_OF', 'SPOUSE_OF', 'ENEMY_OF']) AS type, unnest([NULL, NULL, 'bad_range', 'not_in_chunk']) AS reason, count(*) AS n FROM documents WHERE doc_id % 3 = 0""", False)
def extraction_relations(spark, d):
    parsed = _extracted(spark, d)
    return extract.relations(parsed, extract.entities(parsed))[1].groupBy("type", "reason").agg(F.count("*").alias("n"))


@query("SELECT 'nodes' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges WHERE type IN ('PARENT_OF', 'SPOUSE_OF')")
def backup_restore_counts(spark, d):
    where = shared_folder(spark)
    files.backup(nodes(spark, d), _family(spark, d), where)
    return files.counts(*files.restore(spark, where))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1", False)
def stream_event_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    where = shared_folder(spark)
    e.where("event_id % 2 = 0").write.parquet(f"{where}/in/a")
    ingest.upsert(spark, f"{where}/in/*", e.schema, f"{where}/out", f"{where}/cp", "user_id", ["event_id"])
    e.where("event_id % 2 = 1").write.parquet(f"{where}/in/b")
    ingest.upsert(spark, f"{where}/in/*", e.schema, f"{where}/out", f"{where}/cp", "user_id", ["event_id"])
    return ingest.merged(spark, f"{where}/out", e.schema).select("user_id", "event_id", "event_type")


@query("SELECT date_trunc('day', ts) AS begin, event_type, count(*) AS n FROM events GROUP BY 1, 2", False)
def event_windows(spark, d):
    out = ingest.windowed_counts(table(spark, d, "events"))
    return out.withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT event_type, date_trunc('day', ts) + unnest([0, -1, -2]) * INTERVAL 1 DAY AS begin FROM events) SELECT begin, event_type, count(*) AS n FROM s GROUP BY 1, 2""", False)
def event_sliding_windows(spark, d):
    out = ingest.windowed_counts(table(spark, d, "events"), "3 days", slide="1 day")
    return out.withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k""", False)
def event_sessions(spark, d):
    out = ingest.sessions(table(spark, d, "events"), "2 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begin", "end")})


@query("SELECT count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars, source AS book FROM documents GROUP BY 3", False)
def chunk_manifest(spark, d):
    return files.manifest(chunks(spark, d))

