"""Answers to questions: linking, routing, retrieval, context and generation.

The generator is a provider, a function of question and context; the default one gives the
context's first line, so that everything runs without a network. So is the embedder.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import sequential
from weftgraph.functions.text import tokens
from weftgraph.operators import answer, linking, maintain, match, retrieval, vectors
from weftgraph.schema import ALIAS, ART, PERSON, SECT

# What relations are called in contexts, and in questions.
NAMES = {
    "MASTER_OF": "师徒", "SPOUSE_OF": "夫妻", "PARENT_OF": "父母", "SWORN_BROTHER_OF": "结拜", "ENEMY_OF": "仇敌", "BELONGS_TO": "属于", "MASTERS": "精通",
    "FOUNDER_OF": "创立", "LOCATED_IN": "位于", "BRANCHED_FROM": "演化", "DESCENDANT_OF": "血缘",
}
ASKED_AS = {
    "MASTER_OF": ("师徒", "师父", "师傅", "恩师", "徒弟", "弟子", "师承", "师门"),
    "SPOUSE_OF": ("夫妻", "妻子", "丈夫", "配偶", "夫人", "老婆", "老公"),
    "PARENT_OF": ("父母", "父亲", "母亲", "父子", "父女", "母子", "母女", "子女", "儿子", "女儿", "孩子"),
    "SWORN_BROTHER_OF": ("结拜", "义兄", "义弟", "结义"),
    "ENEMY_OF": ("仇敌", "敌人", "对手", "仇人"),
    "BELONGS_TO": ("门派", "帮派", "所属", "归属"),
    "MASTERS": ("精通", "武功", "绝学", "绝技"),
    "FOUNDER_OF": ("创立", "创始人", "开派"),
    "LOCATED_IN": ("地点", "位于", "所在"),
    "BRANCHED_FROM": ("演化", "源自", "衍生"),
    "DESCENDANT_OF": ("血缘", "后人", "之后", "后代"),
}
#: Where a relation is called otherwise than in NAMES.
CALLED_IN = {"cross_novel": {"BELONGS_TO": "同门", "LOCATED_IN": "所在"}, "page": {"BELONGS_TO": "门派", "LOCATED_IN": "位置", "DESCENDANT_OF": "后裔"}, "context": {"DESCENDANT_OF": "血缘（祖先→后代）"}}
SHOWN = ("师徒", "夫妻", "父母", "结拜", "仇敌", "属于", "精通")
ARROWS = {"symmetric": "--", "backward": "<-"}
MAX_QUESTION, BUDGET = 500, 6000

# Words that say what is asked of a sect and of an art, and a generator's errors.
FOUNDER_WORDS = (*answer.FOUNDING, "谁创", "创始人")
SECT_ART_WORDS = ("绝学", "武功", "会什么", "精通", "成名绝技", "招数")
LEADER_WORDS = ("掌门", "帮主", "教主", "盟主")
ORIGIN_WORDS = ("创始人", "谁创", "谁创造", "源自", "出自", "由谁创", "何人所创")
PRACTICE_WORDS = ("谁会", "哪些人会", "精通")
RETRYABLE = (
    "APITimeoutError", "APIConnectionError", "RateLimitError", "InternalServerError", "ServiceUnavailableError", "Timeout", "ConnectionError", "APIStatusError",
)
FATAL = ("AuthenticationError", "PermissionDeniedError", "BadRequestError", "NotFoundError", "UnprocessableEntityError")
ATTEMPTS = 4


class RequestError(ValueError):
    """A request that cannot be answered; unlike data that is unavailable or empty."""


def checked_question(value: object) -> str:
    if not isinstance(value, str) or not value.strip() or len(value.strip()) > MAX_QUESTION:
        raise RequestError(f"a question has 1 to {MAX_QUESTION} characters")
    return value.strip()


def relation_name(kind: Column, where: str = "") -> Column:
    """What a relation is called, in some places otherwise than in others."""
    return F.coalesce(*[F.when(kind == k, v) for k, v in (NAMES | CALLED_IN.get(where, {})).items()], kind)


def fact_lines(edges: DataFrame) -> DataFrame:
    """edges (src, type, dst, direction) as arrow, triple and step."""
    arrow = F.coalesce(*[F.when(F.col("direction") == k, v) for k, v in ARROWS.items()], F.lit("->"))
    name = relation_name(F.col("type"))
    return edges.select(
        "*", F.concat(F.col("src"), F.lit(" "), arrow, F.lit("["), name, F.lit("] "), F.col("dst")).alias("arrow"),
        F.concat(F.lit("（"), F.col("src"), F.lit("，"), name, F.lit("，"), F.col("dst"), F.lit("）")).alias("triple"),
        F.concat(F.col("src"), F.lit(" --["), name, F.lit("]--> "), F.col("dst")).alias("step"),
    )


def forms(facts: Column) -> dict[str, Column]:
    """Three encodings of one array of facts (src, type, dst): triples, path, subgraph."""
    name = lambda f: relation_name(f["type"])
    ends = F.array_distinct(F.flatten(F.transform(facts, lambda f: F.array(f["src"], f["dst"]))))
    return {
        "triples": F.array_join(F.transform(facts, lambda f: F.concat(F.lit("（"), f["src"], F.lit("，"), name(f), F.lit("，"), f["dst"], F.lit("）"))), "\n"),
        "path": F.array_join(F.transform(facts, lambda f: F.concat(f["src"], F.lit(" --["), name(f), F.lit("]--> "), f["dst"])), "\n"),
        "subgraph": F.concat(F.lit("围绕实体的子图摘要："), F.array_join(ends, "、"), F.lit("\n关系："), F.array_join(F.transform(facts, name), "；")),
    }


def compared_forms(rows: DataFrame, facts: str, keys: list[str]) -> DataFrame:
    """Per keys and form: questions, mean characters and facts, and the shares of contexts that show directions, name relations, or are empty."""
    made = forms(F.col(facts))
    each = rows.select(*keys, F.size(facts).alias("_n"), F.explode(F.map_from_arrays(F.array(*map(F.lit, made)), F.array(*made.values()))).alias("form", "_text"))
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    return each.groupBy(*keys, "form").agg(
        F.count("*").alias("questions"), F.round(F.avg(F.length("_text")), 2).alias("chars"), F.round(F.avg("_n"), 4).alias("facts"),
        share(F.col("_text").rlike("->|<-")).alias("direction_rate"), share(F.col("_text").rlike("|".join(SHOWN))).alias("relation_rate"), share(F.trim("_text") == "").alias("empty_rate"),
    )


def path_completeness(path: Column, hops: Column) -> Column:
    """Share of the expected hops that the path's first unbroken edges (src, dst) cover."""
    n = F.size(path)
    broken = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i < n) & (F.get(path, i - 1)["dst"] != F.get(path, i)["src"]))
    covered = F.when(n <= 0, 0).when(F.size(broken) > 0, F.get(broken, F.lit(0))).otherwise(n)
    return F.round(F.least(F.lit(1.0), covered / F.greatest(hops, F.lit(1))), 4)


def evidence_sufficiency(hit: Column, kinds: Column, relation: Column) -> Column:
    """Half for the answer, half for an edge of the relation asked for (a quarter for any other)."""
    said = F.coalesce(relation, F.lit(""))
    asked = F.exists(kinds, lambda k: F.coalesce(*[F.when(k == t, said.rlike("|".join(words))) for t, words in ASKED_AS.items()], F.lit(False)))
    right = F.when((said == "") | (said == "关系") | asked, 1.0).otherwise(0.5)
    ok = hit.cast("double")
    return F.round(F.when(F.size(kinds) <= 0, ok * 0.5).otherwise((ok + right) / 2), 4)


@answer.register("fulltext")
def text_search(chunks: DataFrame, question: str, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """The k chunks that match the question's tokens best."""
    spark = chunks.sparkSession
    words = spark.createDataFrame([(question,)], "q string").select(tokens(F.col("q")).alias("t")).first()["t"]
    return vectors.bm25(chunks, key, "text", list(dict.fromkeys(words)), k) if words else chunks.select(key, F.lit(0.0).alias("score")).limit(0)


@answer.register("vector")
def vector_search(chunks: DataFrame, question: str, k: int = 5, embedder: retrieval.Embedder | None = None, index: str | None = None) -> DataFrame:
    """The k chunks whose vectors are most like the question's: chunk_id, text, score."""
    found, _ = retrieval.embed_and_search(chunks.sparkSession, index, question, embedder or retrieval.Embedder(), chunks, k)
    return found.select("chunk_id", "text", "score")


@answer.register("chunk_graph")
def search_and_expand(chunks: DataFrame, mentions: DataFrame, edges: DataFrame, question: str, k: int = 5, embedder: retrieval.Embedder | None = None, index: str | None = None) -> DataFrame:
    """Facts about what the most similar chunks mention, at most 12 of a chunk and 2 * k in all."""
    best = vector_search(chunks, question, k, embedder, index)
    facts = match.expand_mentions(mentions.join(best.select("chunk_id"), "chunk_id", "left_semi"), edges)
    return facts.orderBy("chunk_id", "rank").limit(2 * k).select("chunk_id", "name", "type", "other")


@dataclass
class Reply:
    """An answer with how it came about."""

    question: str
    intent: str
    method: str
    status: str
    text: str
    lines: list[str] = field(default_factory=list)
    fallback_from: str = ""
    latency_ms: float = 0.0
    confidence: float = 0.0
    seed: str = ""
    seed_id: str = ""
    injection: str = ""
    notes: dict = field(default_factory=dict)


@dataclass
class Found:
    """What a method found: a status, context lines, and notes such as a question that the ontology cannot answer."""

    status: str
    lines: list[str] = field(default_factory=list)
    notes: dict = field(default_factory=dict)


class EmptyAnswer(RuntimeError):
    """A generator's answer without any text; another try may give one."""


def first_line(question: str, context: str) -> str:
    """The default generator."""
    return context.split("\n", 1)[0]


def generated(generate: Callable[[str, str], str], question: str, context: str, attempts: int = ATTEMPTS, pause: float = 0.0) -> tuple[str, str, int, str]:
    """(text, status, attempts, reason) of a generator; status is ok, no_context or unavailable.

    What its error's name calls passing is tried again, what it calls fatal, or does not name, is not.
    """
    if not context.strip():
        return "", "no_context", 0, ""
    reason = ""
    for attempt in range(1, attempts + 1):
        try:
            text = generate(question, context)
            if text is None:
                raise EmptyAnswer("no answer")
            return text.strip(), "ok", attempt, ""
        except Exception as e:  # a provider's errors are its own
            name = type(e).__name__
            reason = f"{name}: {e}"
            again = name not in FATAL and (name in RETRYABLE or isinstance(e, EmptyAnswer | TimeoutError | ConnectionError))
            if not again:
                return "", "unavailable", attempt, reason
            time.sleep(min(pause * attempt, 6))
    return "", "unavailable", attempts, reason


def says(question: str, words: tuple[str, ...]) -> bool:
    return any(w in question for w in words)


class Engine:
    """Questions over one graph. What it collects are the rows of an answer, at most top_k of them."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, generate: Callable[[str, str], str] = first_line,
                 aliases: DataFrame | None = None, embedder: retrieval.Embedder | None = None, index: str | None = None):
        self.spark, self.nodes, self.edges, self.chunks, self.generate = spark, nodes, edges, chunks, generate
        self.aliases = spark.createDataFrame([], ALIAS) if aliases is None else aliases
        self.embedder, self.index = embedder or retrieval.Embedder(), index
        self.words = linking.LexiconCache(lambda: self.nodes, self.aliases)

    def link(self, question: str, labels: tuple[str, ...] | None = None) -> list[linking.Link]:
        """Entities of a question: its parts are looked up among the names, which stay where they are."""
        return linking.link(question, linking.candidates(self.words.get(), question), labels)

    def route(self, question: str, links: list[linking.Link]) -> dict:
        rows = [(question, [(m.canonical, m.label, m.confidence) for m in links])]
        return linking.intents(self.spark.createDataFrame(rows, "question string, links array<struct<canonical:string,label:string,confidence:double>>")).first().asDict()

    def alias_names(self, links: list[linking.Link], label: str) -> dict[str, str]:
        """Aliases among the linked names that mean one entity of the label."""
        names = sorted({m.name for m in links} | {m.canonical for m in links})
        found = linking.alias_mapping(self.words.get(), label).where(F.col("form").isin(*names)) if names else None
        return {r["form"]: r["canonical"] for r in found.collect()} if found is not None else {}

    def retrieve(self, method: str, question: str, links: list[linking.Link], k: int) -> Found:
        """What one method finds for a question."""
        run = {
            "vector": self._vector, "fulltext": self._fulltext, "chunk_graph": self._chunk_graph, "sect_agg": self._sect, "art_lineage": self._art,
            "master_chain": self._masters, "person_relation": self._relation, "cross_novel": self._cross,
        }[method]
        found = run(question, links, k)
        lines = list(dict.fromkeys(x.strip() for x in found.lines if x and x.strip()))
        return Found("ok" if lines else found.status if found.status != "ok" else "no_result", lines, found.notes)

    def _lines(self, rows: DataFrame, line: Column, **notes) -> Found:
        return Found("ok", [r["line"] for r in rows.select(line.alias("line")).collect()], notes)

    def _vector(self, question: str, links: list[linking.Link], k: int) -> Found:
        rows, reason = retrieval.embed_and_search(self.spark, self.index, question, self.embedder, self.chunks, k)
        return self._lines(rows, F.col("text"), **({"degraded": reason} if reason else {}))

    def _fulltext(self, question: str, links: list[linking.Link], k: int) -> Found:
        best = text_search(self.chunks, question, k)
        return self._lines(best.join(self.chunks, "chunk_id").orderBy(F.desc("score"), "chunk_id"), F.col("text"))

    def _chunk_graph(self, question: str, links: list[linking.Link], k: int) -> Found:
        words = self.nodes.select("name").distinct()
        best = vector_search(self.chunks, question, k, self.embedder, self.index)
        mentions = best.join(words, F.col("text").contains(F.col("name"))).select("chunk_id", "name")  # k chunks, which are broadcast
        facts = match.expand_mentions(mentions, self.edges).orderBy("chunk_id", "rank").limit(2 * k)
        return self._lines(facts, F.concat_ws(" ", "name", "type", "other"))

    def _sect(self, question: str, links: list[linking.Link], k: int) -> Found:
        sect = next((m.canonical for m in links if m.label == SECT), None)
        people = [m for m in links if m.label == PERSON]
        if sect is None:
            if not people or not says(question, FOUNDER_WORDS):
                return Found("no_entity")
            # Of several persons the one that the verb follows, not one who introduces them.
            who = next((m for m in reversed(people) if question[m.end :].lstrip().startswith(answer.FOUNDING)), people[0]).canonical
            return self._lines(answer.sect_agg(self.edges, who, "founded", k), F.concat(F.lit(f"{who}："), "name"))
        what = "founders" if says(question, FOUNDER_WORDS) else "arts" if says(question, SECT_ART_WORDS) else "members"
        notes = {"leader_unsupported": True} if what == "members" and says(question, LEADER_WORDS) else {}
        return self._lines(answer.sect_agg(self.edges, sect, what, k), F.concat(F.lit(f"{sect}："), "name"), **notes)

    def _art(self, question: str, links: list[linking.Link], k: int) -> Found:
        art = next((m.canonical for m in links if m.label == ART), None)
        if art is None:
            return Found("no_entity")
        what = "origin" if says(question, ORIGIN_WORDS) else "practitioners" if says(question, PRACTICE_WORDS) else "lineage"
        return self._lines(answer.art_lineage(self.edges, art, what, k), F.concat_ws(" -> ", "src", "dst"))

    def _masters(self, question: str, links: list[linking.Link], k: int) -> Found:
        person = next((m.canonical for m in links if m.label == PERSON), None)
        if person is None:
            return Found("no_entity")
        hops = self.spark.createDataFrame([(question,)], "q string").select(answer.chain_length(F.col("q"))).first()[0]
        rows = answer.master_chain(self.edges, person, hops, "out" if says(question, answer.DOWN_WORDS) else "in", k)
        return self._lines(rows, F.array_join("names", " -> "))

    def _relation(self, question: str, links: list[linking.Link], k: int) -> Found:
        named = [m for m in links if m.label == PERSON]
        aliases = self.alias_names(named, PERSON)
        focused, people = linking.focus(question, named, aliases)
        if not people:
            return Found("no_entity")
        steps = sequential.plan(focused, [vars(m) for m in people])
        if not steps:
            why = linking.unsupported(question)
            return Found("unsupported_relation", notes={"unsupported": why}) if why else Found("no_relation")
        targets = {i: s["target"] for i, s in enumerate(steps) if s["target"]}
        same = linking.alias_mapping(self.words.get(), PERSON).withColumnRenamed("form", "alias")
        paths = match.traverse(self.edges, people[0].canonical, [(s["relation"], s["direction"]) for s in steps], k, targets, same)
        return self._lines(paths, F.array_join("names", " -> "), plan=sequential.plan_text(steps))

    def _cross(self, question: str, links: list[linking.Link], k: int) -> Found:
        seeds = list(dict.fromkeys(m.canonical for m in links if m.label == PERSON))
        if not seeds:
            return Found("no_entity")
        line = F.format_string("%s 与 %s：%s，%d", "source", "name", F.when(F.col("blood"), "血缘关联").otherwise("一般关联"), "distance")
        if len(seeds) > 1:
            return self._lines(answer.cross_pairs(self.edges, seeds, k), line)
        return self._lines(answer.cross_novel(self.nodes, self.edges, seeds[0], k).withColumn("source", F.lit(seeds[0])), line)

    def ask(self, question: object, method: str | None = None, k: object = 5) -> Reply:
        """Answer by a method, or by the one that the question's intent names.

        A graph method without evidence gives way to vector search if that has some.
        """
        began, text, limit = time.perf_counter(), checked_question(question), maintain.top_k(k)
        if method is not None and method not in answer.METHODS:
            raise RequestError(f"unknown method {method}")
        links = self.link(text)
        intent = self.route(text, links)
        name, left = method or intent["method"], ""
        found = self.retrieve(name, text, links, limit)
        if method is None and found.status != "ok" and name != "vector":
            other = self.retrieve("vector", text, links, limit)
            if other.lines:
                left, name, found = name, "vector", Found(other.status, other.lines, found.notes | other.notes)
        kept = within_budget(found.lines, BUDGET)
        said, status, attempts, reason = generated(self.generate, text, "\n".join(kept)[:BUDGET])
        notes = found.notes | {"attempts": attempts} | ({"reason": reason} if reason else {})
        status = {"unavailable": "degraded"}.get(status, status)
        injection = self.spark.range(1).select(linking.injection_name(F.lit(name))).first()[0]
        return Reply(text, intent["intent"], name, status, said, kept, left, 1000 * (time.perf_counter() - began), intent["confidence"], intent["seed"], intent["seed_id"], injection, notes)

    def query(self, sql: str, params: dict | None = None, eras: list[str] | None = None) -> DataFrame:
        """A SQL query over the tables nodes, edges and chunks, with named parameters, and :eras where it has them.

        Raises Unavailable for a query that cannot run.
        """
        given = dict(params or {})
        if "eras" not in given and eras:
            given["eras"] = F.array(*map(F.lit, eras))
        elif "eras" not in given:
            sql = re.sub(r":eras\b", "CAST(NULL AS ARRAY<STRING>)", sql)
        names = {f"weft_{t}_{uuid.uuid4().hex}": t for t in ("nodes", "edges", "chunks")}
        for view, t in names.items():
            getattr(self, t).createOrReplaceTempView(view)
        ctes = ", ".join(f"{t} AS (SELECT * FROM {view})" for view, t in names.items())
        own = sql.strip()
        whole = f"WITH {ctes}, {own[4:]}" if own[:5].upper() == "WITH " else f"WITH {ctes} {own}"
        try:
            return self.spark.sql(whole, args=given or None)
        except PySparkException as e:
            raise retrieval.Unavailable(str(e).splitlines()[0]) from e
        finally:
            for view in names:
                self.spark.catalog.dropTempView(view)

    def health(self) -> dict:
        """Whether the tables can be read, what the index was made by, whether names are degraded, and the methods."""
        out: dict = {"graph": "ok", "index": None, "error": "", "methods": sorted(answer.METHODS)}
        try:
            self.nodes.limit(1).count()
            out["index"] = retrieval.read_meta(self.spark, self.index) if self.index else None
        except PySparkException as e:
            out |= {"graph": "unavailable", "error": str(e).splitlines()[0]}
        self.words.get()
        return out | {"names_degraded": self.words.degraded_reason}


def within_budget(lines: list[str], budget: int) -> list[str]:
    """Lines until one would pass the budget; the first always stays."""
    kept, used = [], 0
    for line in lines:
        if kept and used + len(line) > budget:
            break
        kept.append(line)
        used += len(line) + 1
    return kept


def report_json(summary: DataFrame, title: str) -> str:
    """A summary as JSON, as report() has it as Markdown."""
    return json.dumps({"title": title, "rows": [r.asDict(recursive=True) for r in summary.collect()]}, ensure_ascii=False, default=str)


def report(summary: DataFrame, title: str) -> str:
    """A summary as a Markdown table; a row for each group of a summary, so it is small."""
    rows = summary.collect()
    head = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + "---|" * len(summary.columns)]
    return "\n".join(head + ["| " + " | ".join("-" if v is None else str(v) for v in r) + " |" for r in rows])
