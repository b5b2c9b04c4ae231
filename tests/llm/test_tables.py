import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import lpt_shards, url_markov
from weftgraph.llm import queries as Q


def lpt(sizes: list[int], shards: int) -> list[int]:
    loads = [0] * shards
    for s in sorted(sizes, reverse=True):
        heapq.heapreplace(loads, loads[0] + s)
    return sorted(loads)


def test_schedule_is_longest_first():
    rng = random.Random(1)
    sizes = {str(i): rng.randrange(1, 1000) for i in range(200)}
    plan = lpt_shards.schedule(sizes, 7)
    assert sorted(sum(n for u, n in sizes.items() if plan[u] == s) for s in range(7)) == lpt(list(sizes.values()), 7)


def test_shards(spark, docs):
    rng = random.Random(2)
    texts = ["x" * rng.randrange(3000) for _ in range(500)] + ["é" * 2000] * 300
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = lpt_shards.shard_documents(frame).collect()
    by_text = {}
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        assert by_text.setdefault(t, r["shard"]) == r["shard"]
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    rest = sorted(loads)[:-1]  # the copies, which stay together, fill one shard alone
    assert max(rest) - min(rest) < 0.05 * max(rest)
    edge = lpt_shards.shard_documents(docs)
    assert edge.count() == docs.count() and edge.select("shard", "slot").distinct().count() == docs.count()
    assert lpt_shards.shard_documents(docs.where("false")).count() == 0


def test_many_small_groups_share_units(spark):
    frame = spark.range(5000).select("id", F.lit(1).alias("size"))
    out = lpt_shards.assign(frame, "id", "size", 4, grain=8)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 4 and max(counts) - min(counts) < 400


PARTS = [
    ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
    ("ftp://a.b.example.com/en/1", "a.b.example.com", "/en/1", "example.com/en/", "block"), ("http://other.com", "other.com", "", None, None), ("http://other.com/", "other.com", "/", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), ("http://xnet/es/1", "xnet", "/es/1", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None), ("http://h.com#x/y", "h.com", "", None, None), ("http://h.com?x=/y", "h.com", "", None, None), ("http://É.COM/En", "É.com", "/En", "com/", "allow"),
]


def test_url_parts_and_rules(spark):
    frame = spark.createDataFrame([(i, p[0], "x", 1) for i, p in enumerate(PARTS)], "page_id long, url string, host string, score int")
    got = {r["page_id"]: r for r in url_markov.judge(frame).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(PARTS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert url_markov.judge(frame.where("false")).count() == 0
    assert url_markov.judge(frame.unionByName(frame)).count() == 2 * len(PARTS)


def test_url_model_tells_classes_apart(spark):
    rng = random.Random(3)
    word = lambda s: "".join(rng.choice(s) for _ in range(8))
    good = [f"http://{word('abcde')}.com/{word('abcde')}" for _ in range(200)]
    bad = [f"http://{word('vwxyz')}.net/es/{word('vwxyz')}" for _ in range(200)]
    new = [f"http://{word('abcde')}.org/{word('abcde')}" for _ in range(40)] + [f"http://{word('vwxyz')}.org/{word('vwxyz')}" for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(new + good + bad)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_markov.judge(frame).collect()}
    assert all(got[i] == "allow" for i in range(40)) and all(got[i] == "block" for i in range(40, 80))


def markov(labelled: list[tuple[str, bool]]):
    """The score of a URL by two plain interpolated models."""
    order, start = url_markov.ORDER, url_markov.START
    count, seen = Counter(), defaultdict(set)
    for url, accepted in labelled:
        for o in range(order + 1):
            padded = start * o + url
            for i in range(len(url)):
                gram = padded[i : i + o + 1]
                count[accepted, o, gram] += 1
                count[accepted, "of", o, gram[:-1]] += 1
                seen[accepted, o, gram[:-1]].add(gram)

    def p(accepted, o, gram):
        if o < 0:
            return 1 / url_markov.ALPHABET
        n, t = count[accepted, "of", o, gram[:-1]], len(seen[accepted, o, gram[:-1]])
        below = p(accepted, o - 1, gram[1:])
        return count[accepted, o, gram] / (n + t) + t / (n + t) * below if n else below

    def score(url):
        padded = start * order + url
        return sum(math.log(p(True, order, padded[i : i + order + 1]) / p(False, order, padded[i : i + order + 1])) for i in range(len(url))) / max(1, len(url))

    return score


@pytest.mark.parametrize("bound", [url_markov.BROADCAST_GRAMS, 0])
def test_url_model_grows_with_its_texts(spark, monkeypatch, bound):
    """Over 30,000 different grams, each counted by itself, as a plain model counts them."""
    monkeypatch.setattr(url_markov, "BROADCAST_GRAMS", bound)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    labelled = [(f"http://{word(20)}.com/{word(20)}", True) for _ in range(450)] + [(f"http://{word(20)}.net/es/é{word(20)}", False) for _ in range(450)]
    assert len({u[i : i + 4] for u, _ in labelled for i in range(len(u))}) > 30_000
    asked = [u for u, _ in labelled[::30]] + [f"http://{word(9)}.org/{word(9)}" for _ in range(30)] + ["", "é", "日本"]
    model = url_markov.fit(spark.createDataFrame(labelled, "url string, accepted boolean"))
    rows = spark.createDataFrame(list(enumerate(asked + asked[-5:])), "_row long, url string")
    got = {r["_row"]: r["score"] for r in url_markov.with_score(rows, model).collect()}
    score = markov(labelled)
    assert len(got) == len(asked) + 5
    for i, url in enumerate(asked + asked[-5:]):
        assert abs(got[i] - score(url)) < 1e-6


def test_queries_have_a_name_for_each_operator():
    names = sorted(Q.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
