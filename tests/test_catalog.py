import hashlib
import random
import re

import pytest
from oracle import database, of_spark, of_sql

from weftgraph.operators import align
from weftgraph.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert of_spark(catalog.queries()[name](spark, SF)) == of_sql(con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_extractions_see_whole_texts(spark):
    parsed = {r["chunk_id"]: r["text"] for r in catalog._extracted(spark, SF).select("chunk_id", "text").collect()}
    texts = {r["chunk_id"]: r["text"] for r in catalog.chunks(spark, SF).collect()}
    assert parsed.keys() == texts.keys() and all(parsed[k].endswith(t) for k, t in texts.items() if t is not None)
    assert max(len(t or "") for t in texts.values()) > 10_000


def plain_spans(text, size=1500, overlap=200):
    """Spans by looking at every sentence end for each of them."""
    ends = sorted({m.end() for m in re.finditer(r"[。！？!?；;…\n]+", text)} | {len(text)})
    out, start = [], 0
    while text and (not out or out[-1][1] < len(text)):
        edge = min(start + size, len(text))
        stop = max((e for e in ends if start < e <= edge), default=edge)
        stop = edge if stop - start < size // 3 and stop < len(text) else stop
        out.append((start, stop))
        start = max(max((e for e in ends if start < e <= stop - overlap), default=stop - overlap), start + 1)
    if len(out) > 1 and out[-1][1] - out[-1][0] < overlap:
        out[-2:] = [(out[-2][0], len(text))]
    return out


def test_chunks_equal_plain_ones(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, a, b, hashlib.sha256(t[a:b].encode()).hexdigest()[:16]) for i, t in texts.items() for a, b in plain_spans(t)}
    assert {tuple(r) for r in catalog.queries()["doc_chunks"](spark, SF).collect()} == want and len(want) > len(texts)


def alike(names):
    """Every pair of names is scored by a plain longest common subsequence."""

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(a) + len(b))

    def score(a, b):
        short, long = sorted((a, b), key=len)
        return max(ratio(a, b), max(ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)))

    names = sorted(names)
    pairs = {(a, b): score(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if abs(len(a) - len(b)) <= 2}
    return {p: round(s, 4) for p, s in pairs.items() if round(s, 4) >= 0.85}


def test_similar_names_equal_all_pairs(spark):
    names = {r["p_name"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    got = {(r["a"], r["b"]): r["score"] for r in catalog.queries()["similar_name_pairs"](spark, SF).collect()}
    assert got == pytest.approx(alike(names), abs=1e-4)


def test_similar_short_names_equal_all_pairs(spark):
    rng = random.Random(47)
    names = {"".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(1, 16))) for _ in range(260)}
    base = sorted(n for n in names if len(n) > 6)
    names |= {n[:k] + rng.choice("甲乙戊") + n[k + rng.randrange(2) :] for n in base for k in [rng.randrange(len(n))]}
    frame = spark.createDataFrame([("人物", n) for n in sorted(names)], "label string, name string")
    got = {(r["a"], r["b"]): r["score"] for r in align.similar_pairs(frame).collect()}
    want = alike(names)
    assert len({len(a) for a, _ in want}) > 8 and got == pytest.approx(want, abs=1e-4)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["sect", "art", "n_persons", "persons"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
