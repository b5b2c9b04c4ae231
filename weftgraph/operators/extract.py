"""From an extractor's answers to clean entities and relations.

The extractor is a provider: any function of a chunk's text that gives JSON. The offline provider
of the tests is deterministic; a remote one plugs in the same way.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftgraph.functions.text import evidence_gate, is_noise, stripped, without_fence
from weftgraph.operators.match import both_ways, check_relations
from weftgraph.schema import ART, ART_TYPES, LABELS, PAYLOAD, RELATIONS, SECT, ontology


# Names of a provider's errors that no second try mends.
FATAL = ("AuthenticationError", "PermissionDeniedError", "BadRequestError", "NotFoundError")


def ask(chunks: DataFrame, provider: Callable[[str], str], attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """chunks with answer, error and attempts; an error's name says whether it is tried again.

    An answer that is no JSON object is tried again too. What stays is the last answer, if there was one.
    """

    @pandas_udf("answer string, error string, attempts int")
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(text: str) -> tuple[str | None, str | None, int]:
            said, error = None, None
            for attempt in range(1, attempts + 1):
                try:
                    said, error = provider(text), None
                    if said is not None and _object(said):
                        return said, None, attempt
                except Exception as e:  # a provider's errors are its own
                    said, error = None, f"{type(e).__name__}: {e}"
                    if type(e).__name__ in FATAL:
                        return None, error, attempt
                if attempt < attempts:
                    time.sleep(min(pause * 2 ** (attempt - 1), 8))
            return said, error, attempts

        return pd.DataFrame([one(t) for t in texts], columns=["answer", "error", "attempts"])

    return chunks.withColumn("_said", run(F.col("text"))).select(*chunks.columns, "_said.answer", "_said.error", "_said.attempts")


# What the relations mean, for extractors.
MEANING = {
    "MASTER_OF": "师徒：A 是 B 的师父（有向）", "SPOUSE_OF": "夫妻（双向）", "PARENT_OF": "父母子女：A 是 B 的父母（有向）", "SWORN_BROTHER_OF": "结拜（双向）", "ENEMY_OF": "仇敌（双向）",
    "BELONGS_TO": "所属门派：A 属于门派 B（有向）", "MASTERS": "精通武功：A 精通武功 B（有向）",
}


def prompt(text: Column) -> Column:
    """What a language model is asked about a text, with the entities and relations of the ontology."""
    relations = "\n".join(f"- {t}（{MEANING.get(t, '、'.join(a) + ' → ' + '、'.join(b))}）" for t, a, b, _ in RELATIONS)
    head = f"从文本中抽取实体（{'、'.join(LABELS)}；武功另有 art_type：{'/'.join(ART_TYPES)}）和以下关系，只用这些关系，每条关系带原文中逐字的 evidence：\n{relations}\n"
    tail = '\n只返回 JSON：{"entities": [{"name", "type", "era", "description", "location", "art_type"}], "relationships": [{"source", "target", "type", "evidence"}]}'
    return F.concat(F.lit(head), F.lit("文本：\n"), F.coalesce(text, F.lit("")), F.lit(tail))


def payload_or_empty(parsed: DataFrame) -> DataFrame:
    """parsed with a payload without entities and relations in the place of one that could not be read."""
    none = F.from_json(F.lit('{"entities": [], "relationships": []}'), PAYLOAD + ", _bad string")
    return parsed.withColumn("payload", F.when(F.col("status").isin("ok", "empty"), F.col("payload")).otherwise(none))


def _object(answer: str) -> bool:
    begin, end = answer.find("{"), answer.rfind("}")
    try:
        return begin >= 0 and isinstance(json.loads(answer[begin : end + 1]), dict)
    except ValueError:
        return False


def parse(answers: DataFrame) -> DataFrame:
    """answers with payload and status: ok, empty, retryable if the answer is no such JSON, or fatal if the error says so."""
    said = F.regexp_extract(without_fence(F.col("answer")), r"(?s)(\{.*\})", 1)
    payload = F.from_json(said, PAYLOAD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = answers.withColumn("payload", payload)
    fatal = F.coalesce(F.substring_index("error", ":", 1).isin(*FATAL), F.lit(False)) if "error" in answers.columns else F.lit(False)
    bad = F.col("answer").isNull() | F.col("payload").isNull() | F.col("payload._bad").isNotNull() | (said == "")
    none = (F.coalesce(F.size("payload.entities"), F.lit(0)) <= 0) & (F.coalesce(F.size("payload.relationships"), F.lit(0)) <= 0)
    return out.withColumn("status", F.when(fatal, "fatal").when(bad, "retryable").when(none, "empty").otherwise("ok"))


def _named(parsed: DataFrame, era: str) -> DataFrame:
    """What chunks say of entities, with known types and names: chunk_id, pos, type, name, era, description, location, art_type."""
    e = parsed.where("status = 'ok'").select("chunk_id", F.col(era).alias("chunk_era"), F.posexplode("payload.entities").alias("pos", "e"))
    given = stripped(F.coalesce("e.type", F.lit("")))
    kind = F.when(given.isin(*ART_TYPES), ART).otherwise(given)
    art_type = F.when(F.col("e.art_type").isin(*ART_TYPES), F.col("e.art_type")).when(given.isin(*ART_TYPES), given)
    e = e.select("chunk_id", "pos", kind.alias("type"), stripped(F.coalesce("e.name", F.lit(""))).alias("name"),
                 F.coalesce(F.nullif(stripped(F.coalesce("e.era", F.lit(""))), F.lit("")), "chunk_era").alias("era"),
                 F.substring(F.coalesce("e.description", F.lit("")), 1, 500).alias("description"),
                 F.when(kind == SECT, F.col("e.location")).alias("location"), F.when(kind == ART, art_type).alias("art_type"))
    return e.where(F.col("type").isin(*LABELS) & ~is_noise(F.col("name")))


def type_conflicts(parsed: DataFrame, era: str = "era") -> DataFrame:
    """chunk_id, name, kept, given of names that a chunk gives another type than it gave first; these are rejected."""
    e = _named(parsed, era)
    first = e.groupBy("chunk_id", "name").agg(F.min_by("type", "pos").alias("kept"))
    return e.join(first, ["chunk_id", "name"]).where("type != kept").select("chunk_id", "name", "kept", F.col("type").alias("given")).distinct()


def entities(parsed: DataFrame, era: str = "era") -> DataFrame:
    """Clean entities of chunks: chunk_id, type, name, era, description, location, art_type.

    An art type given as the type means an art. Unknown types and noise names go; of names that
    a chunk gives two types, the first type stays; type_conflicts() has the others.
    """
    e = _named(parsed, era)
    first = e.groupBy("chunk_id", "name").agg(F.min_by(F.struct("type", "era", "description", "location", "art_type"), "pos").alias("v"))
    return first.select("chunk_id", "name", "v.*")


def relations(parsed: DataFrame, clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted relations (chunk_id, type, src, dst, evidence), and all with the reason against each."""
    spark = parsed.sparkSession
    r = parsed.where("status = 'ok'").select("chunk_id", "text", F.explode("payload.relationships").alias("r"))
    r = r.select("chunk_id", "text", F.upper(stripped(F.coalesce("r.type", F.lit("")))).alias("type"), stripped(F.coalesce("r.source", F.lit(""))).alias("src"),
                 stripped(F.coalesce("r.target", F.lit(""))).alias("dst"), F.substring(F.coalesce("r.evidence", F.lit("")), 1, 300).alias("evidence"))
    a = clean.select("chunk_id", F.col("name").alias("src"), F.col("type").alias("src_label"))
    b = clean.select("chunk_id", F.col("name").alias("dst"), F.col("type").alias("dst_label"))
    r = check_relations(r.join(a, ["chunk_id", "src"], "left").join(b, ["chunk_id", "dst"], "left"), ontology(spark))
    reason, adopted = evidence_gate(F.col("type"), F.col("src"), F.col("dst"), F.col("evidence"), F.col("text"))
    missing = F.when(F.col("reason").isin("bad_domain", "bad_range") & (F.col("src_label").isNull() | F.col("dst_label").isNull()), "not_in_chunk")
    r = r.withColumn("reason", F.coalesce(missing, "reason", reason)).withColumn("evidence", adopted)
    good = r.where("reason IS NULL").select("chunk_id", "type", "src", "dst", "evidence").distinct()
    pairs = both_ways(good, ontology(spark))
    proof = good.select("chunk_id", "type", "src", "dst", "evidence").unionByName(good.select("chunk_id", "type", F.col("dst").alias("src"), F.col("src").alias("dst"), "evidence"))
    proof = proof.groupBy("chunk_id", "type", "src", "dst").agg(F.min("evidence").alias("evidence"))
    return proof.join(pairs, ["type", "src", "dst"], "left_semi"), r.select("chunk_id", "type", "src", "dst", "reason")
