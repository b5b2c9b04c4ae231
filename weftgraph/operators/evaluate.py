"""Runs over sets of questions, what they score, and whether a stored graph holds together."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import affirmed
from weftgraph.operators import answer, service
from weftgraph.schema import LABELS, RELATIONS

RESULT = (
    "id string, question string, category string, hop int, intent string, method string, injection string, status string, confidence double, seed string, hit boolean, answer string, "
    "evidence_count int, lines array<string>, latency_ms double, error string"
)


def path_validity(edges: Column) -> Column:
    """Share of edges (type, direction) of a known relation and direction; 0 without edges."""
    good = F.filter(edges, lambda e: F.upper(e["type"]).isin(*[r[0] for r in RELATIONS]) & F.coalesce(e["direction"], F.lit("forward")).isin("forward", "backward", "symmetric"))
    return F.when(F.size(edges) > 0, F.round(F.size(good) / F.size(edges), 4)).otherwise(0.0)


def evaluated(rows: DataFrame) -> DataFrame:
    """rows (answer, accepted, expected, answered, edges, hop, relation) with all the figures of an answer.

    edges are structs src, dst, type, direction; answered are the names that the answer gives.
    """
    hit = F.exists("accepted", lambda a: affirmed(F.col("answer"), a))
    recall, precision, f1 = answer.precision_recall(F.col("expected"), F.col("answered"))
    steps = F.transform("edges", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst")))
    kinds = F.transform("edges", lambda e: e["type"])
    return rows.withColumn("hit", hit).withColumns({
        "entity_recall": recall, "entity_precision": precision, "entity_f1": f1, "exact_match": recall == 1.0, "path_completeness": service.path_completeness(steps, F.col("hop")),
        "evidence_sufficiency": service.evidence_sufficiency(F.col("hit"), kinds, F.col("relation")), "path_validity": path_validity(F.col("edges")), "evidence_count": F.size("edges"),
    })


def run(engine: service.Engine, questions: Iterable[dict], method: str | None = None, k: int = 5, done: Iterable[str] = ()) -> DataFrame:
    """Results of questions (id, question, category, hop, acceptable_answers) that are not done, one by one.

    A question that fails has the status error and does not end the run. The set is read on the driver, as
    each question is a query of its own.
    """
    skip, out = set(done), []
    for q in questions:
        if q["id"] in skip:
            continue
        began = time.perf_counter()
        head = (q["id"], q["question"], q.get("category"), q.get("hop"))
        try:
            r = engine.ask(q["question"], method, k)
            rest = (r.intent, r.method, r.injection, r.status, float(r.confidence), r.seed, r.text, len(r.lines), r.lines, r.latency_ms, None)
        except Exception as e:  # whatever a question does
            rest = ("error", method or "?", "?", "error", 0.0, "", "", 0, [], 1000 * (time.perf_counter() - began), f"{type(e).__name__}: {e}")
        out.append((*head, *rest[:6], list(q.get("acceptable_answers") or []), *rest[6:]))
    schema = RESULT.replace("hit boolean", "accepted array<string>")
    rows = engine.spark.createDataFrame(out, schema)
    return rows.withColumn("hit", F.exists("accepted", lambda a: affirmed(F.col("answer"), a))).select(*[c.split(" ")[0] for c in RESULT.split(", ")])


def with_questions(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Results (question_id, ...) with category, hop and source_hint of their questions, for grouping."""
    return results.join(questions.select(F.col("id").alias("question_id"), "category", "hop", "source_hint"), "question_id")


def verification(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Figures of a stored graph as rows (section, name, n): chunks by book and version, entities by label and era, attributes,
    evidence of relations, and snippets that their first chunk holds.

    nodes has label, name, era, description, location, art_type; edges type, chunk_ids, snippets; chunks
    chunk_id, book, dataset_version, text, embedding.
    """
    of = lambda df, section, name, n: df.select(F.lit(section).alias("section"), name.alias("name"), n.cast("long").alias("n"))
    known = nodes.where(F.col("label").isin(*LABELS))
    facts = edges.where("type != 'MENTIONS'")
    held = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    by_book = chunks.groupBy(F.coalesce("book", F.lit("?")).alias("book"), F.coalesce("dataset_version", F.lit("legacy")).alias("version")).agg(F.count("*").alias("n"), F.count("embedding").alias("e"))
    by_era = known.groupBy("label", F.coalesce("era", F.lit("<null>")).alias("era")).agg(F.count("*").alias("n"))
    attributes = known.agg(*[F.count(c).alias(c) for c in ("description", "location", "art_type")], F.count_if(F.col("description") != "").alias("described"), F.count("*").alias("all"))
    evidence = facts.agg(F.count("*").alias("all"), F.count_if(held("chunk_ids")).alias("with_chunks"), F.count_if(held("snippets")).alias("with_snippets"))
    quoted = facts.where(held("chunk_ids") & held("snippets")).select(F.get("chunk_ids", F.lit(0)).alias("chunk_id"), F.get("snippets", F.lit(0)).alias("snippet"))
    quoted = quoted.join(chunks.select("chunk_id", F.col("text").alias("_t")), "chunk_id", "left")
    proof = quoted.agg(F.count("*").alias("quoted"), F.count("_t").alias("chunk_exists"), F.count_if(F.coalesce((F.col("snippet") != "") & F.col("_t").contains(F.col("snippet")), F.lit(False))).alias("snippet_in_chunk"))
    rows = of(by_book, "chunks", F.concat_ws("/", "book", "version"), F.col("n")).unionByName(of(by_book, "embedded", F.concat_ws("/", "book", "version"), F.col("e")))
    rows = rows.unionByName(of(by_era, "entities", F.concat_ws("/", "label", "era"), F.col("n")))
    for section, df in (("attributes", attributes), ("evidence", evidence), ("snippets", proof)):
        each = df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("name", "n"))
        rows = rows.unionByName(of(each, section, F.col("name"), F.col("n")))
    return rows


def snippets_found(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """src, type, dst, chunk_id, snippet of edges that are quoted, whether the chunk exists, and whether it holds the snippet."""
    quoted = edges.where((F.size("chunk_ids") > 0) & (F.size("snippets") > 0)).select("src", "type", "dst", F.get("chunk_ids", F.lit(0)).alias("chunk_id"), F.get("snippets", F.lit(0)).alias("snippet"))
    met = quoted.join(chunks.select("chunk_id", F.col("text").alias("_t")), "chunk_id", "left")
    holds = F.coalesce((F.col("snippet") != "") & F.col("_t").contains(F.col("snippet")), F.lit(False))
    return met.select("src", "type", "dst", "chunk_id", "snippet", F.col("_t").isNotNull().alias("chunk_exists"), holds.alias("found"))


def embedded_chunks(chunks: DataFrame) -> DataFrame:
    """Per book and version: chunks, those with a vector, and the least and most numbers that a vector has."""
    return chunks.groupBy("book", "dataset_version").agg(F.count("*").alias("n"), F.count("embedding").alias("n_embedded"), F.min(F.size("embedding")).alias("dim_min"), F.max(F.size("embedding")).alias("dim_max"))


def attributes(nodes: DataFrame, names: tuple[str, ...] = ("era", "description", "location", "art_type")) -> DataFrame:
    """Per label: nodes, and how many have each attribute and a text in it."""
    there = [c for c in names if c in nodes.columns]
    return nodes.groupBy("label").agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_with_{c}") for c in there], *[F.count_if(F.col(c) != "").alias(f"n_filled_{c}") for c in there])


def run_stats(rows: DataFrame) -> DataFrame:
    """Per status of an ingestion: chunks and characters."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def numbered(parts: list[DataFrame], key: str, buckets: int = 64) -> DataFrame:
    """Rows of several sets, in the order of the sets and of their keys, as q001, q002 and so on.

    Rows are numbered within ranges of keys, and a range begins where those before it end.
    """
    rows = None
    for i, p in enumerate(parts):
        one = p.withColumn("_part", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    low, high = rows.agg(F.min(key), F.max(key)).first()
    width = max(1.0, (float(high or 0) - float(low or 0) + 1) / buckets)
    rows = rows.withColumn("_bucket", F.floor((F.col(key) - F.lit(low or 0)) / width))
    before = Window.partitionBy("_all").orderBy("_part", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part", "_bucket").count().withColumn("_all", F.lit(0))  # a row for each set and range
    starts = counts.select("_part", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    number = F.row_number().over(Window.partitionBy("_part", "_bucket").orderBy(key))
    out = rows.withColumn("_n", number).join(F.broadcast(starts), ["_part", "_bucket"])
    return out.select(F.format_string("q%03d", F.col("_from") + F.col("_n")).alias("id"), key)
