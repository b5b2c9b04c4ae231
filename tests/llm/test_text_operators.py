import hashlib
import itertools
import os
import random
import re
import string
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import components, passes, secrets, shingles, without_repeats
from brute import order_minhash as plain_fingerprint
from pyspark.sql import functions as F

from weftgraph.llm import bpe, jaccard_join, langid, lpf_dedup, order_minhash, rff_quality, spaced_seeds, trigram_scan

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return bpe.Encoder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(encoder.vocabulary.rank), special_tokens={})


def test_bpe_equals_the_library_on_random_texts(encoder, reference):
    rng = random.Random(1)
    signs = "aaabbb  \n\t\x1c\x1f\x85\u3000é中文字😀'sSthe 1290!!?..___%%$$\xa0\u200b\r"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)] + [w * n for w in ("a", "the", "=-") for n in (1, 7, 500)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert encoder.decode(ids).decode() == t


def test_bpe_appends_and_edits(encoder):
    rng = random.Random(2)
    for _ in range(200):
        x = "".join(rng.choice("the and of\n12é") for _ in range(rng.randrange(1, 150))).encode()
        cut, i = rng.randrange(len(x)), rng.randrange(len(x))
        j = min(len(x), i + rng.randrange(5))
        table = bpe.PrefixTable(encoder.vocabulary, x[:cut]).append(x[cut:])
        assert table.last == bpe.PrefixTable(encoder.vocabulary, x).last
        assert table.replace(i, j, b"zq the").last == bpe.PrefixTable(encoder.vocabulary, x[:i] + b"zq the" + x[j:]).last
        assert b"".join(encoder.vocabulary.token[t] for t in table.ids(5)) == table.data[:5]


#: Prints the MB that an encoder takes beyond its vocabulary when its caches are full, and that stay when it forgets.
FULL_CACHES = """
import random, re, sys
from weftgraph.llm import bpe, common

def taken():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

with open(sys.argv[1], "rb") as f:
    encoder = bpe.Encoder(f.read(), sys.argv[2])
common.give_back()
rng, first = random.Random(3), taken()
for _ in range(260):
    text = " ".join(rng.randbytes(5).hex().translate({48 + i: 103 + i for i in range(10)}) for _ in range(2000))
    ids, same = bpe._round_trip(encoder, text)
    assert same
full = taken()
encoder.forget()
common.give_back()
print(full - first, taken() - first)
"""


def test_bpe_caches_leave_room(encoder):
    """Two tasks share an executor with what earlier stages of the pipeline left in it."""
    out = subprocess.run([sys.executable, "-c", FULL_CACHES, PATH, public_tokenizers.PATTERN], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    full, left = map(float, out.stdout.split())
    assert full < 130 and left < 30


def test_bpe_cases(spark, docs, reference):
    got = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    want = set()
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest(), len(ids)))
    assert got == want
    assert bpe.encode(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_trigram_queries():
    assert trigram_scan.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert trigram_scan.trigram_query("[0-9a-f]+") is True
    assert trigram_scan.trigram_query("abc|de") is True
    assert trigram_scan.trigram_query("xab?c") == ("or", (("and", ("xab", "abc")), "xac"))


def test_postings_hold_every_row(monkeypatch):
    rng = random.Random(35)
    texts = ["".join(rng.choice("akiAKI é\0") for _ in range(rng.randrange(40))) for _ in range(80)] + ["", "ak", "aki"]
    trigrams = frozenset(("aki", "kia", "a k", "zzz", "é12"))
    for piece in (1 << 21, 5):
        monkeypatch.setattr(trigram_scan, "PIECE", piece)
        index = trigram_scan.BlockIndex(texts, trigrams)
        folded = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in texts]
        for t in trigrams - {"é12"}:
            assert index.postings(t) == {i for i, x in enumerate(folded) if t in x}
        assert index.postings("é12") == set(range(len(texts)))


def test_secrets_equal_brute_force(spark, docs):
    rng = random.Random(3)
    parts = ["password", "Token", "api_key", "APIKEY", " = ", ":", '"', "abcdef12", "AKIA", "ABCDEFGH01234567", "deadbeef" * 3, "x", " ", "\n", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert trigram_scan.report(docs).count() == docs.count() and trigram_scan.report(docs.where("false")).count() == 0
    for r in trigram_scan.report(frame).collect():
        want = secrets(texts[r["doc_id"]])
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for k, _, _ in want) for n in ("assign", "access", "hex")]
        assert r["base_sha256"] == trigram_scan.digest(want)


def test_redaction(docs):
    out = trigram_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    r = out.where("doc_id = 12").first()
    assert r["text"] == "x [REDACTED] y token: ab [REDACTED]".replace("x [REDACTED]", 'x [REDACTED]"') and r["n_chars"] == len(r["text"])
    assert out.where("doc_id = 1").first()["text"] is None


@pytest.mark.parametrize("pivots", [0, 6, 512])
def test_jaccard_equals_brute_force(spark, docs, texts, monkeypatch, pivots):
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    rng = random.Random(4)
    base = [[rng.choice(string.ascii_lowercase) + str(rng.randrange(200)) for _ in range(rng.choice([4, 6, 9, 40, 120, 200, 400]))] for _ in range(25)]
    rows = []
    for i in range(250):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(len(words) // 12 + 2)):
            words[rng.randrange(len(words))] = rng.choice(["new", "Other", "x"]) + str(rng.randrange(5))
        rows.append((100 + 3 * i, (" " if i % 2 else "\n").join(words)))
    want = components(rows)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(shingles(dict(rows)[r["doc_id"]])) for r in got)
    got = jaccard_join.join(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == components(sorted(texts))
    assert jaccard_join.join(docs.where("false")).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (6, 7, 10)").count() == 0 and kept.where("doc_id IN (1, 2, 3, 4, 5)").count() == 5
    assert kept.where("doc_id IS NULL").count() == 1


def test_blocks_do_not_change_words(monkeypatch):
    rng = random.Random(33)
    texts = ["".join(rng.choice("aB é\t\n日") for _ in range(rng.randrange(200))) for _ in range(60)] + ["x" * 90 + " y" * 3, " ", ""]
    want = [jaccard_join._words(t).tolist() for t in texts]
    assert all(len(w) == len([x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]) for t, w in zip(texts, want, strict=True))
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    assert [jaccard_join._words(t).tolist() for t in texts] == want


def test_voronoi_regions():
    """Of two sets that link both are in a region, and one of them is in its core, or both are in the empty set's."""
    rng = random.Random(14)
    base = [rng.sample(range(10**6), rng.choice([3, 20, 80, 300])) for _ in range(12)]
    sets = []
    for _ in range(300):
        x = set(rng.choice(base))
        for _ in range(rng.randrange(len(x))):
            if rng.random() < 0.7:
                x.discard(rng.choice(sorted(x)) if len(x) > 1 else -1)
            else:
                x.add(rng.randrange(10**6))
        sets.append(np.array(sorted(x), np.uint64))
    pivots = jaccard_join.Pivots([(i, x) for i, x in enumerate(sets[:60])])
    kept = [set(sets[i].tolist()) for i in pivots.ids]
    d = lambda x, y: 1 - len(x & y) / len(x | y)
    assert len(kept) > 8 and all(d(x, y) >= 0.75 for x, y in itertools.combinations(kept, 2))
    found = [(set(x.tolist()), *pivots.regions(x)) for x in sets]
    for x, regions, pivot in found:
        near = min(range(len(kept)), key=lambda p: d(x, kept[p]))
        assert (pivot == near) == (d(x, kept[near]) <= 0.25) and (-1 in regions) == (d(x, kept[near]) > 0.5)
    linked = [(a, b) for a, b in itertools.combinations(found, 2) if d(a[0], b[0]) <= 0.25]
    assert len(linked) > 100 and all(set(a[1]) & set(b[1]) for a, b in linked)


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_repeats_equal_brute_force(spark, docs, texts, monkeypatch, crowd):
    monkeypatch.setattr(lpf_dedup, "CROWD", crowd)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 150))) for _ in range(20)]
    rows = []
    for i in range(60):
        t = [rng.choice(base), rng.choice(base) + rng.choice(base), "a" * rng.randrange(300), base[0][:37] * rng.randrange(9), base[1][:150] + " ".join(rng.choice(words) for _ in range(60))][i % 5]
        p = rng.randrange(len(t) + 1)
        rows.append((2 * i, t[:p] + "Z" * (i % 2) + t[p:]))
    for some in (rows, sorted(texts)):
        want = without_repeats(some)
        frame = spark.createDataFrame(some, "doc_id long, text string").repartition(4) if some is rows else docs
        got = lpf_dedup.remove_repeats(frame).where("doc_id IS NOT NULL").collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert lpf_dedup.remove_repeats(docs.where("false")).count() == 0
    assert lpf_dedup.remove_repeats(docs).where("doc_id IS NULL").first()["n_removed"] == 0


def test_lpf_array():
    rng = random.Random(6)
    for _ in range(50):
        s = bytes(rng.choice(b"ab") for _ in range(rng.randrange(30)))
        want = [max((k for j in range(p) for k in range(len(s) - p + 1) if s[j : j + k] == s[p : p + k]), default=0) for p in range(len(s))]
        assert lpf_dedup.lpf(s) == want


def test_leaks(spark, docs, benchmark):
    got = {(r["doc_id"], r["item_id"]) for r in spaced_seeds.leaks(docs, benchmark).collect()}
    assert got == {(5, 1), (6, 1), (7, 1), (9, 4), (10, 4)}
    changed = "the lazy dog and NOW it runs far away from here to the WRONG side of town the quick brown fox"
    one = spark.createDataFrame([(1, "lead in " + changed + " lead out"), (2, "the lazy dog and then some other thing happens here to the people of that town instead")], "doc_id long, text string")
    assert [r["doc_id"] for r in spaced_seeds.leaks(one, benchmark).collect()] == [1]
    assert spaced_seeds.leaks(docs, benchmark.where("false")).count() == 0 == spaced_seeds.leaks(docs.where("false"), benchmark).count()
    kept = spaced_seeds.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 6


def test_leaks_without_broadcast(docs, benchmark, monkeypatch):
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 0)
    assert spaced_seeds.leaks(docs, benchmark).count() == 5


def plain_leaks(docs, items) -> set:
    """(doc_id, item_id) by laying every item at every place of every document."""

    def tokens(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    out = set()
    for item_id, item in ((i, tokens(t)) for i, t in items):
        least = min(12, -(-3 * len(item) // 4))
        for doc, found in ((d, tokens(t)) for d, t in docs):
            for shift in range(1 - len(item), len(found)) if item and found else ():
                equal = [0 <= k + shift < len(found) and found[k + shift] == w for k, w in enumerate(item)]
                if passes(equal, least):
                    out.add((doc, item_id))
                    break
    return out


@pytest.mark.parametrize("bound", [0, 10**6])
def test_leaks_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", bound)
    rng = random.Random(31)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 11, 15, 16, 20, 24])))) for i in range(16)]
    docs = []
    for d in range(50):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 30))]
        base = rng.choice(items)[1].split()
        a = rng.randrange(len(base))
        piece = [w if rng.random() < 0.8 else rng.choice(words) for w in base[a * (d % 2) :]]
        p = rng.randrange(len(t) + 1)
        docs.append((d, " ".join(t[:p] + piece + t[p:])))
    got = spaced_seeds.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == plain_leaks(docs, items)


def test_decontamination_judges_rows(spark):
    """Rows without an id, or of one id, go only for their own text."""
    item = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item, 1), (None, "a clean text", 2), (3, f"so {item}", 3), (3, "clean too", 4), (4, None, 5), (4, None, 5)], "doc_id long, text string, tokens int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["tokens"] for r in spaced_seeds.decontaminate(docs, items).collect()) == [2, 4, 5, 5]
    assert spaced_seeds.decontaminate(docs, items.where("false")).count() == 6


def test_masks_hit_all_that_passes():
    """No text of up to 31 tokens with 12 equal, and three quarters of all, is without a hit."""
    hits = [sum(1 << (m[-1] - o) for o in m) for m in spaced_seeds.MASKS]
    level = {(0, 0, 0)}
    for _ in range(31):
        longer = {((h << 1 | b) & 31, ones + b, zeros + 1 - b) for h, ones, zeros in level for b in (0, 1)}
        level = {(h, ones, zeros) for h, ones, zeros in longer if not any(h & x == x for x in hits)}
        assert not any(ones >= spaced_seeds.LEAST and 3 * zeros <= ones for _, ones, zeros in level)
    for n in range(1, spaced_seeds.LONG):
        for equal in itertools.product((False, True), repeat=n):
            if sum(equal) >= min(spaced_seeds.LEAST, 0.75 * n):
                assert any(all(equal[i + o] for o in m) for m in spaced_seeds.short_masks(n) for i in range(n - m[-1]))


@pytest.mark.parametrize("bound", [spaced_seeds.BROADCAST_SEEDS, 0])
def test_leaks_with_substitutions(spark, monkeypatch, bound):
    """Every so many words replaced, in items of all lengths, and words replaced at random."""
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", bound)
    rng = random.Random(11)
    items = {n: [f"i{n}x{j}" for j in range(n)] for n in (1, 2, 3, 4, 5, 7, 8, 9, 10, 12, 15, 16, 17, 20, 29, 40, 59)}
    texts, want = [], set()
    for n, words in items.items():
        cases = [[j % period != phase for j in range(n)] for period in range(4, 11) for phase in range(period)]
        cases += [[j not in gone for j in range(n)] for k in (n // 5, n // 4, n // 4 + 1, n // 3) for gone in (rng.sample(range(n), k) for _ in range(4))]
        for equal in cases:
            if passes(equal, min(12, -(-3 * n // 4))):
                want.add((len(texts), n))
            texts.append(" ".join(["before"] * 3 + [w if same else f"other{j}" for j, (w, same) in enumerate(zip(words, equal, strict=True))] + ["after"] * 3))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in spaced_seeds.leaks(frame, benchmark).collect()} == want


@pytest.mark.parametrize("bound", [spaced_seeds.BROADCAST_SEEDS, 0])
def test_leaks_of_inner_runs(spark, monkeypatch, bound):
    """A verbatim run from anywhere in a longer item leaks from LEAST tokens on, and is judged by itself."""
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", bound)
    item = [f"i{j}" for j in range(40)]
    runs = [(n, start) for n in (11, 12, 15, 18, 22, 23, 40) for start in range(40 - n + 1)]
    texts = [" ".join([f"b{j}" for j in range(20)] + item[start : start + n] + [f"a{j}" for j in range(20)]) for n, start in runs]
    two = " ".join(item[:13] + ["x"] * 4 + item[17:20] + ["x"] * 5 + item[25:40])  # 13, 3 and 15: together 31 of 40, which passes
    frame = spark.createDataFrame([*enumerate(texts), (len(texts), two)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_equal"], r["share"], r["first_token"]) for r in spaced_seeds.leaks(frame, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {**{i: (n, 1.0, 20) for i, (n, _) in enumerate(runs) if n >= spaced_seeds.LEAST}, len(texts): (31, 31 / 40, 0)}


def test_fingerprints(spark, docs, texts):
    got = order_minhash.compare_edits(docs).collect()
    assert len(got) == docs.count()
    order = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in docs.collect()))
    want = set()
    for i, (doc, t) in enumerate(order):
        k = len(t) // 2
        e = t[: len(t) - k] + order[(i + 1) % len(order)][1][:k]
        want.add((None if doc < 0 else doc, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got} == want
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[5] == prints[6] != prints[7] and prints[1] == prints[2]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert order_minhash.compare_edits(docs.where("false")).count() == 0


def test_fingerprints_see_order(spark):
    rng = random.Random(7)
    words = [str(rng.randrange(10**6)) for _ in range(600)]
    variants = [words, words[:300] + ["x"] + words[300:], words[300:] + words[:300], rng.sample(words, 600)]
    rows = order_minhash.fingerprints(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(variants)], "doc_id long, text string"))
    sig = {r["doc_id"]: set(r["signature"]) for r in rows.collect()}
    near = [len(sig[0] & sig[i]) / 64 for i in range(4)]
    assert near[0] == 1 and near[1] > 0.9 and near[1] > near[2] > 0.2 and near[3] < 0.05


def order_minhash_likeness(one: list[str], two: list[str]) -> float:
    """Likeness of texts without repeated words, by 64 independent orders."""

    def entry(words, seed):
        at = {tuple(words[i : i + 3]): i for i in range(len(words) - 2)}
        least = sorted(at, key=lambda k: hashlib.sha256(f"{seed} {k}".encode()).digest())[:2]
        return sorted(least, key=at.get)

    return sum(entry(one, seed) == entry(two, seed) for seed in range(64)) / 64


def test_short_texts_see_order(spark):
    """Texts of 20 to 600 words with their halves swapped are as like as by independent orders."""
    rng = random.Random(9)
    rows, want = [], {}
    for n in (20, 40, 66, 130, 600):
        pairs = []
        for i in range(30):
            words = [f"w{x}" for x in rng.sample(range(10**6), n)]
            other = words[n // 2 :] + words[: n // 2]
            pairs.append(order_minhash_likeness(words, other))
            rows.append((n, i, " ".join(words), " ".join(other), " ".join([*words, "end"])))
        want[n] = sum(pairs) / len(pairs)
    frame = spark.createDataFrame(rows, "n int, i int, a string, b string, c string")
    for c in "abc":
        frame = order_minhash.with_signature(frame, c, f"s{c}")
    near = lambda x, y: F.avg(order_minhash.likeness(F.col(x), F.col(y)))
    got = {r["n"]: r for r in frame.groupBy("n").agg(near("sa", "sb").alias("swapped"), near("sa", "sc").alias("longer"), F.min(F.size("sa")).alias("bins")).collect()}
    for n, expected in want.items():
        assert abs(got[n]["swapped"] - expected) < 0.07 and got[n]["longer"] > 0.8 and got[n]["bins"] == 64
    tiny = {r["doc_id"]: r["signature"] for r in order_minhash.fingerprints(spark.createDataFrame([(1, "a"), (2, "a b c"), (3, "a b c"), (4, None)], "doc_id long, text string")).collect()}
    assert tiny[2] == tiny[3] != tiny[1] and all(len(x) == 64 for x in tiny.values())


def test_parts_of_a_text_have_the_same_tokens(spark):
    """Neither length nor script of the rest of a text changes what a part of it gives."""
    rng = random.Random(19)
    japanese = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(400))
    english = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(40_000))
    blob = "".join(rng.choice("0123456789abcdef") for _ in range(4000))
    rows = [(japanese, japanese[:200] + english), (long, long + " and nine more words at the end of it all"), (blob, blob[:2000] + english)]
    frame = spark.createDataFrame(rows, "a string, b string")
    for c in "ab":
        frame = order_minhash.with_signature(frame, c, f"s{c}")
    near = [r[0] for r in frame.select(order_minhash.likeness(F.col("sa"), F.col("sb"))).collect()]
    assert near[0] > 0.1 and near[1] > 0.95 and near[2] > 0.05
    cases = ["", " ", "a  b", " ab\tc ", "日本 x語", "x" * 40, None]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(order_minhash.tokens(F.coalesce("t", F.lit("")))).collect()
    assert [r[0] for r in got] == [[""], [""], ["a", "b"], ["ab", "c"], ["日", "本", "x", "語"], ["x" * 16, "x" * 16, "x" * 8], [""]]


@pytest.mark.parametrize("ids", [[None] * 40 + list(range(60)), [7] * 70 + [8] * 5 + list(range(100, 160)), [*range(90), 1 << 60, (1 << 60) + 1, -(1 << 62)], [5], [None, None], [3, 3, 3]])
def test_next_rows(spark, monkeypatch, ids):
    """Every row's next one is the next in the order, whatever the ids' spread."""
    monkeypatch.setattr(order_minhash, "NEIGHBOURS", 2)
    monkeypatch.setattr(order_minhash, "QUANTILES", 5)
    rows = spark.createDataFrame([(x, f"text {i}") for i, x in enumerate(ids)], "doc_id long, text string").repartition(5)
    got = order_minhash.with_next(rows, ["doc_id", "text"]).withColumn("h", F.xxhash64("text")).collect()
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]))
    assert len(got) == len(ids) and [(r["next_doc_id"], r["next_text"]) for r in order] == [(r["doc_id"], r["text"]) for r in [*order[1:], order[0]]]


def test_fingerprints_equal_plain_ones(spark, docs):
    """Fingerprints, and likenesses to edited and next texts, k-mer by k-mer in plain Python."""
    rng = random.Random(51)
    words = ["".join(rng.choice("abcé日ก") for _ in range(rng.randrange(1, 22))) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 2, 3, 4, 5, 8, 20, 60, 130, 400) for _ in range(2)] + ["a b c d " * 20, " \t", "日本語" * 30, None]
    got = order_minhash.compare_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    plain = [t or "" for t in texts]
    as_text = lambda sig: ".".join(f"{x:X}" for x in sig)
    near = lambda a, b: len(set(a) & set(b)) / 64
    assert len(got) == len(texts)
    for r in got:
        one, other = plain[r["doc_id"]], plain[(r["doc_id"] + 1) % len(plain)]
        half = len(one) // 2
        sig, edited = plain_fingerprint(one), plain_fingerprint(one[: len(one) - half] + other[:half])
        assert r["fingerprint"] == as_text(sig) and r["edited_fingerprint"] == as_text(edited)
        assert abs(r["near_edited"] - near(sig, edited)) < 1e-9 and abs(r["near_next"] - near(sig, plain_fingerprint(other))) < 1e-9


def test_signatures_count_repeats(spark):
    one, two = "a b c d " * 30, "a b c d " * 60
    rows = order_minhash.fingerprints(spark.createDataFrame([(0, one), (1, two), (2, one)], "doc_id long, text string"))
    sig = {r["doc_id"]: r["signature"] for r in rows.collect()}
    assert sig[0] == sig[2] != sig[1] and len(sig[1]) > 10


def test_languages(spark, docs):
    rng = random.Random(8)
    letters = {"aa": "abcde", "bb": "xyzuv", "cc": "мнопр"}
    rows = [(i, " ".join("".join(rng.choice(letters[x]) for _ in range(5)) for _ in range(rng.randrange(1, 80))), x) for i in range(400) for x in [rng.choice(list(letters))]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    got = langid.identify(frame, model).collect()
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in got if r["held_out"]) >= 0.99 * sum(r["held_out"] for r in got)
    marked = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(marked[i]["lang_pred"] == "und" and marked[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert all(0 <= r["score"] <= 1 for r in marked.values()) and langid.identify(docs, model).count() == docs.count()
    kept = langid.keep_known(docs, langid.fit(docs))
    assert kept.columns == docs.columns and not {1, 2, 3, 8} & {r["doc_id"] for r in kept.collect()}
    empty = langid.fit(docs.where("false"))
    assert langid.identify(docs, empty).where("lang_pred != 'und'").count() == 0


def test_strange_texts_are_rejected(spark):
    """Texts of no learned language are rejected, those of learned ones are not."""
    rng = random.Random(23)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    noise = ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(400)]
    strange = [" ".join(rng.sample(noise, 60)) for _ in range(20)] + ["Быстрая лиса прыгает через ленивую собаку. " * 5, "色は匂へど散りぬるを我が世誰ぞ常ならむ" * 5]
    assert sum(model.predict(t)[2] for t in strange) <= 2
    held = langid.identify(docs.where("text IS NOT NULL"), model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    known = [r for r in held if r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == r["lang"] for r in known) > 0.98 * len(known) and sum(r["accepted"] for r in known) > 0.98 * len(known)


def test_every_language_is_learned(spark):
    rng = random.Random(29)
    rows = []
    for k in range(12):
        words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(60)]
        rows += [(100 * k + i, " ".join(rng.choices(words, k=80)), f"x{k}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    assert len(model.languages) == 12
    got = langid.identify(frame, model).join(frame, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.9 * len(got)


def test_blocks_do_not_change_a_text(monkeypatch):
    text = "Ünder the straße 12 über, " * 40
    whole = np.sort(np.concatenate(list(langid._blocks(text))))
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (np.sort(np.concatenate(list(langid._blocks(text)))) == whole).all()


def test_quality(spark, docs):
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + ("!!" if bad else "") for _ in range(rng.randrange(5, 60))), 0 if bad else 1) for i in range(400) for bad in [i % 4 == 0]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = frame.select("doc_id", "quality")
    got = rff_quality.classify(frame.select("doc_id", "text"), labels).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == rows[r["doc_id"]][2] for r in held) >= 0.97 * len(held)
    out = rff_quality.classify(docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (5, 0), (5, 1)], "doc_id long, quality int")))
    assert out.count() == docs.count() and out.where("score < 0 OR score > 1 OR isnan(score)").count() == 0
    assert {r["score"] for r in rff_quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert rff_quality.classify(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize("fan", [2, 16])
def test_quality_equals_a_plain_fit(spark, monkeypatch, fan):
    """The scores are those of one ridge regression over all rows at once, in plain numpy."""
    monkeypatch.setattr(rff_quality, "FAN", fan)
    rng = random.Random(41)
    rows = [(i, " ".join("".join(rng.choice("abC! 1") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30))), rng.randrange(2)) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(9)
    model = rff_quality.fit(rff_quality.measure(frame), frame.select("doc_id", "quality"))
    held = {r["doc_id"] for r in rff_quality.classify(frame, frame.select("doc_id", "quality")).where("held_out").collect()}
    part = {r[0]: r[1] for r in frame.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(5))).collect()}
    used = [r for r in rows if r[0] not in held and part[r[0]] > 0]
    stats = np.array([rff_quality.statistics(t) for _, t, _ in used])
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.scale, np.where(stats.std(axis=0) > 1e-9, stats.std(axis=0), 1.0))
    z, y = model.lifted(stats), np.array([q for *_, q in used], float)
    n = rff_quality.FEATURES + 1
    want = np.linalg.solve(z.T @ z + rff_quality.RIDGE * len(used) * np.eye(n) / rff_quality.FEATURES, z.T @ y)
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    # The kernel of the features comes near a Gaussian one.
    x = np.clip((stats - model.mean) / model.scale, -6, 6)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z[:, :-1] @ z[:, :-1].T - np.exp(-d / (2 * len(rff_quality.NAMES) * rff_quality.WIDTH**2))).mean() < 0.08


def test_predictions_equal_plain_averages():
    """A score is the softmax of the mean row of all letter pairs and triples, counted one by one."""
    rng = random.Random(43)
    rows = [(" ".join("".join(rng.choice("abcde" if k else "vwxyz") for _ in range(4)) for _ in range(20)), "one" if k else "two") for k in (0, 1) for _ in range(60)]
    model = langid.train(rows)

    def plain(text):
        letters = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
        found = []
        for i in range(1, len(letters) - 1):
            if letters[i]:
                before, here, after = letters[i - 1 : i + 2]
                pair = (here * 0x9E3779B1 + after * 0x85EBCA77) % 2**32
                found += [(pair * 0x165667B1 % 2**32) >> 17, (((pair ^ (before * 0xC2B2AE3D % 2**32)) * 0x27D4EB2F) % 2**32) >> 17]
        mean = sum(model.table[max(1, r)].astype(float) for r in found) / len(found)
        e = np.exp((mean + model.bias) / model.temperature)
        return e / e.sum()

    for text in [t for t, _ in rows[::7]] + ["a", "abc, xyz!", "Éa1b"]:
        name, score, _ = model.predict(text)
        p = plain(text)
        assert abs(score - p.max()) < 1e-5 and name == model.languages[int(p.argmax())]


def test_isotonic_levels_rise():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    knots, levels = rff_quality.isotonic(x, (x + rng.normal(size=300) > 0).astype(float))
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
