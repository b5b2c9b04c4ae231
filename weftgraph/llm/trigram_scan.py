"""Secret scans through a trigram inverted index.

From the parsed form of each rule's regular expression a Boolean query over trigrams is
derived that every text with a match must satisfy. Texts are indexed in blocks of BLOCK
documents, which bounds an index: one pass over a block's bytes makes the posting list of each
trigram that a rule needs. Postings are intersected and united as the queries say, and only candidates are run through the
regular expression. A rule whose expression has no mandatory trigram scans its whole block.
Nothing is shuffled: a block's index, its queries and its verification need no other block.

Case is folded in the index only, which can add candidates but never lose one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import give_back, id_and_text

#: Sets of literal alternatives larger than this are cut into trigrams where they stand.
MAX_ALTERNATIVES = 64

#: Documents of a block, which has an index of its own, and bytes that are read at a time.
BLOCK, PIECE = 2048, 1 << 21

#: A query: True (no condition), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple


@dataclass(frozen=True)
class Rule:
    """Matches of pattern count if their group has at least min_length characters.

    Without regard to case, only ASCII letters are folded.
    """

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0
    any_case: bool = False

    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | re.IGNORECASE if self.any_case else 0)


#: The three kinds of secrets that the queries ask for.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)


def _both(a: Query, b: Query) -> Query:
    if a is True:
        return b
    return a if b is True or a == b else ("and", (a, b))


def _either(parts: list[Query]) -> Query:
    if any(p is True for p in parts):
        return True
    return parts[0] if len(set(parts)) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _of_literals(words: set[str]) -> Query:
    """Every word of the set has trigrams, or there is no condition."""
    found = []
    for w in sorted(words):
        grams = list(dict.fromkeys(w[i : i + 3] for i in range(len(w) - 2)))
        if not grams:
            return True
        found.append(grams[0] if len(grams) == 1 else ("and", tuple(grams)))
    return _either(found)


def _literals(item) -> set[str] | None:
    """The strings that one parsed item can match, if they are few; else None."""
    op, arg = item
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        if len(arg) <= 4 and all(o is C.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        return None
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, what = arg
        inner = _sequence(what)
        if inner is None or high is C.MAXREPEAT or high > 3:
            return None
        out, power = set(), {""}
        for n in range(high + 1):
            if n >= low:
                out |= power
            power = {a + b for a in power for b in inner}
            if len(power) > MAX_ALTERNATIVES:
                return None
        return out
    return {""} if op is C.AT else None


def _sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        more = _literals(item)
        if more is None or len(out) * len(more) > MAX_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in more}
    return out


def _required(items) -> Query:
    """Conditions of a sequence: of its runs of literals, and inside what breaks them."""
    query, run = True, {""}
    for item in items:
        words = _literals(item)
        if words is not None and len(run) * len(words) <= MAX_ALTERNATIVES:
            run = {a + b for a in run for b in words}
            continue
        query, run = _both(query, _of_literals(run)), words or {""}
        op, arg = item
        if words is not None:
            continue
        if op is C.SUBPATTERN:
            query = _both(query, _required(arg[3]))
        elif op is C.BRANCH:
            query = _both(query, _either([_required(p) for p in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            query = _both(query, _required(arg[2]))
    return _both(query, _of_literals(run))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query (in lower case) that texts with a match of pattern satisfy."""
    return _required(parser.parse(pattern))


def _trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(_trigrams(part) for part in query[1]))


@cache
def _wanted(trigrams: frozenset[str]) -> tuple[np.ndarray, dict[str, int]]:
    """For each three bytes the number of the trigram that they are, and the numbers by trigram (ASCII ones)."""
    numbers = {t: k + 1 for k, t in enumerate(sorted(t for t in trigrams if t.isascii()))}
    table = np.zeros(1 << 24, np.uint8 if len(numbers) < 256 else np.int32)
    for t, k in numbers.items():
        a, b, c = t.encode()
        table[a << 16 | b << 8 | c] = k
    return table, numbers


_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


class BlockIndex:
    """The inverted index of one block, for the trigrams that some queries ask for: rows by trigram.

    It is made by one pass over the block's bytes, ASCII letters in lower case; a trigram with other
    characters has no list, and all rows are its candidates.
    """

    def __init__(self, texts: list[str], trigrams: frozenset[str]):
        self.n = len(texts)
        table, numbers = _wanted(trigrams)
        found: dict[int, set[int]] = {k: set() for k in numbers.values()}
        rows, parts, size = [], [], 0
        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(raw) - 2), PIECE):
                rows.append(i)
                parts.append(raw[at : at + PIECE + 2])
                size += len(parts[-1])
                if size >= PIECE:
                    self._read(rows, parts, table, found)
                    rows, parts, size = [], [], 0
        self._read(rows, parts, table, found)
        self.lists = {t: frozenset(found[k]) for t, k in numbers.items()}

    @staticmethod
    def _read(rows: list[int], parts: list[bytes], table: np.ndarray, found: dict[int, set[int]]) -> None:
        """Add the rows of these parts of texts to the lists of the trigrams that they hold."""
        flat = _FOLDED[np.frombuffer(b"\0\0".join(parts) + b"\0\0", np.uint8)]  # no trigram reaches over the gap
        ends = np.cumsum([len(p) + 2 for p in parts])
        codes = flat[:-2].astype(np.uint32)
        codes <<= 8
        codes |= flat[1:-1]
        codes <<= 8
        codes |= flat[2:]
        hits = table[codes]
        at = np.flatnonzero(hits)
        held = np.array(rows, np.int64)[np.searchsorted(ends, at, "right")]
        for k in np.unique(hits[at]).tolist():
            found[k].update(np.unique(held[hits[at] == k]).tolist())

    def postings(self, trigram: str) -> frozenset[int]:
        found = self.lists.get(trigram)
        return frozenset(range(self.n)) if found is None else found

    def candidates(self, query: Query) -> frozenset[int] | range:
        if query is True:
            return range(self.n)
        if isinstance(query, str):
            return self.postings(query)
        kind, parts = query
        out = None
        for part in parts:
            rows = frozenset(self.candidates(part))
            out = rows if out is None else out & rows if kind == "and" else out | rows
            if kind == "and" and not out:
                break
        return out


def find(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text of a block its (start, end, rule number), in that order."""
    queries = [trigram_query(rule.pattern) for rule in rules]
    index, out = BlockIndex(texts, frozenset().union(*map(_trigrams, queries))), [[] for _ in texts]
    for k, rule in enumerate(rules):
        search = rule.regex().finditer
        if rule.group == 0 and (one := re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)) and rule.min_length:
            # Runs of one class are maximal, so short ones need not be visited.
            search = re.compile(f"{one[1]}{{{rule.min_length},}}").finditer
        for i in index.candidates(queries[k]):
            for m in search(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.min_length:
                    out[i].append((m.start(), m.end(), k))
    for spans in out:
        spans.sort(key=lambda s: (s[0], s[2]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield batch.slice(start, BLOCK)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and findings: array of (kind, start, end) by start, then by order of the rules.

    Positions count code points; end is exclusive. A null or empty text has no findings.
    Every row is scanned by itself, so repeated rows give repeated results; other columns of
    docs are ignored and an empty table gives an empty result.
    """
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            found = find(batch.column(1).to_pylist(), rules)
            rows = [[{"kind": kinds[k], "start": a, "end": b} for a, b, k in spans] for spans in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "findings"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, findings array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every secret of text replaced by mark, and n_chars counted anew.

    Secrets that overlap are replaced as one. Rows keep their place and columns; a text
    without secrets, a null one included, stays as it is, with its n_chars.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            texts = batch.column("text").to_pylist()
            found = find([t or "" for t in texts], rules)
            counts = batch.column("n_chars").to_pylist()
            for i, spans in enumerate(found):
                if not spans:
                    continue
                out, at, text = [], 0, texts[i]
                for start, end, _ in spans:
                    if start >= at:
                        out += [text[at:start], mark]
                    at = max(at, end)
                texts[i] = "".join(out) + text[at:]
                counts[i] = len(texts[i])
            columns = [pa.array(texts, pa.string()) if c == "text" else pa.array(counts, pa.int64()) if c == "n_chars" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document the number of findings of each kind, their digest and their list."""
    found = scan(docs, rules)
    joined = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    kinds = F.transform("findings", lambda f: f["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules]
    out = found.select("doc_id", *counts, joined.alias("spans"))
    return out.select(*[c for c in out.columns if c != "spans"], F.sha2("spans", 256).alias("base_sha256"), "spans")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
