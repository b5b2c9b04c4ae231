import json

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import evaluate, linking, maintain, match, retrieval
from weftgraph.schema import ALIAS
from weftgraph.sources import files, state


def test_settings_are_typed_and_clamped():
    s = state.Settings.read({"WEFTGRAPH_TOP_K": "99", "WEFTGRAPH_BUDGET": "x", "WEFTGRAPH_EMBED_FALLBACK": "Yes", "WEFTGRAPH_OVERLAP": "2000"})
    assert (s.top_k, s.budget, s.embed_fallback, s.chunk_size) == (50, 6000, True, 1500) and s.problems()
    assert not state.Settings.read({}).problems() and not state.get_bool("X", env={"WEFTGRAPH_X": "off"}) and state.get_bool("X", True, {"WEFTGRAPH_X": "?"})


def test_manifests_merge(spark, tmp_path):
    where = str(tmp_path / "m")
    assert state.update_manifest(spark, where, a={}) is None
    chunks = spark.createDataFrame([("b", "射雕", "xyz"), ("b", "射雕", "z")], "book string, era string, text string")
    made = state.write_manifest(chunks, where, "v2", extraction={"model": "m"})
    assert made["books"] == {"b": {"era": "射雕", "chunk_count": 2, "total_chars": 4}} and "T" in made["generated_at"]
    merged = state.update_manifest(spark, where, extraction={"prompt": "p"}, note="n")
    assert merged["extraction"] == {"model": "m", "prompt": "p"} and state.read_sidecar(spark, where) == merged


def test_checkpoints_belong_to_their_data(spark, tmp_path):
    where, mark = str(tmp_path / "c"), state.Signature("b", "v2", "abc")
    assert state.read_checkpoint(spark, where, mark) is None
    done = spark.createDataFrame([("1", "h", "ok", ""), ("2", "h", "retryable", "x" * 600)], "chunk_id string, content_hash string, status string, error string")
    state.write_checkpoint(done, where, mark)
    kept = state.read_checkpoint(spark, where, mark)
    assert kept.agg(F.max(F.length("error"))).first()[0] == 500
    chunks = spark.createDataFrame([("1", "h"), ("2", "h"), ("3", "h")], "chunk_id string, content_hash string")
    assert sorted(r[0] for r in state.to_do(chunks, kept).select("chunk_id").collect()) == ["2", "3"]
    assert state.to_do(chunks, None).count() == 3
    for other in (state.Signature("b", "v3", "abc"), state.Signature("b", "v2", "x")):
        with pytest.raises(state.Incompatible):
            state.read_checkpoint(spark, where, other)
    state.read_checkpoint(spark, where, state.Signature())
    state.write_sidecar(spark, f"{where}/signature", ["1", "2"])
    with pytest.raises(state.Incompatible):
        state.read_checkpoint(spark, where, mark)


def test_commits_are_whole(spark, tmp_path):
    where = str(tmp_path / "g")
    one, two = spark.range(3), spark.range(5)
    assert state.commit(spark, where, {"nodes": one, "edges": two}) == 0
    bad = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        state.commit(spark, where, {"nodes": two, "edges": bad})
    assert state.read_version(spark, where, "nodes").count() == 3
    assert state.commit(spark, where, {"edges": one}) == 1 and state.read_version(spark, where, "edges").count() == 3 and state.read_version(spark, where, "nodes").count() == 3
    with pytest.raises(files.DataError):
        state.read_version(spark, where, "chunks")


def test_schema_guards(spark):
    df = spark.createDataFrame([("1", [1.0]), ("2", None)], "chunk_id string, embedding array<double>")
    assert state.checked(df, {"chunk_id": "string"}, ["chunk_id"]) is df and state.checked_vectors(df, "embedding", 1) is df
    for case in (lambda: state.checked(df, {"x": "string"}), lambda: state.checked(df.unionByName(df), {}, ["chunk_id"]), lambda: state.checked_vectors(df, "embedding", 2)):
        with pytest.raises(files.DataError):
            case()


def test_chunk_files(spark, tmp_path):
    (tmp_path / "chunks_射雕英雄传.json").write_text(json.dumps([{"chunk_id": "1", "text": "a"}, {"chunk_id": "2", "text": "b", "book": "B", "era": "神雕"}]))
    (tmp_path / "chunks_bad.json").write_text("{")
    got = {r["chunk_id"]: (r["book"], r["era"]) for r in files.read_chunk_files(spark, str(tmp_path)).collect()}
    assert got == {"1": ("射雕英雄传", "射雕"), "2": ("B", "神雕")}
    assert files.read_chunk_files(spark, str(tmp_path), ["射雕"]).count() == 2 and files.read_chunk_files(spark, str(tmp_path), ["倚天"]).count() == 0
    assert [r["chunk_id"] for r in files.read_chunks(spark, str(tmp_path / "none"), otherwise=str(tmp_path)).collect()] == ["2", "1"]
    old = tmp_path / "old"
    old.mkdir()
    (old / "chunks.json").write_text(json.dumps([{"chunk_id": "9", "text": "x", "book": "倚天屠龙记"}]))
    assert files.read_chunk_files(spark, str(old)).first()["era"] == "倚天"


def test_books_of_unknown_era_or_encoding_are_refused(spark, tmp_path):
    (tmp_path / "别的书.txt").write_text("甲来。")
    with pytest.raises(files.DataError, match="别的书"):
        files.build_chunks(files.read_books(spark, str(tmp_path)), str(tmp_path / "out"))
    (tmp_path / "神雕侠侣.txt").write_bytes(b"\xff\xff\x80")
    with pytest.raises(files.DataError, match="encoding"):
        files.read_books(spark, str(tmp_path), strict=True)


def test_aliases_and_candidates(spark, tmp_path):
    f = tmp_path / "a.json"
    assert files.read_aliases(spark, str(f)).count() == 0
    f.write_text("{")
    assert files.read_aliases(spark, str(f)).count() == 0
    f.write_text('[{"alias": "a", "canonical": "b", "label": "人物", "applicable_eras": ["射雕"]}]')
    assert files.read_aliases(spark, str(f)).first()["canonical"] == "b"
    pairs = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 1.0)], "a string, b string, score double")
    files.write_candidates(pairs, str(tmp_path / "csv"), made="today")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("*.csv"))).decode()
    assert text.splitlines()[:2] == ["﻿a,b,score,decision,made", 'c,d,1.0,"",today']


def test_backups_hold_vectors(spark, tmp_path):
    n, e = spark.createDataFrame([], "label string"), spark.createDataFrame([], "type string")
    v = spark.createDataFrame([("1", [0.5, 1.0])], "chunk_id string, embedding array<double>")
    assert {r["kind"]: r["n"] for r in files.backup(n, e, str(tmp_path / "b"), v).collect()} == {"nodes": 0, "edges": 0, "embeddings": 1}
    assert files.restore_vectors(spark, str(tmp_path / "b")).first()["embedding"] == [0.5, 1.0] and files.restore_vectors(spark, str(tmp_path / "x")).count() == 0


def test_links_have_sources_and_confidence(spark):
    entries = [("郭靖", "郭靖", "人物", "射雕", "graph"), ("郭靖", "郭靖", "人物", "神雕", "graph"), ("靖哥哥", "郭靖", "人物", None, "alias"), ("丐帮", "丐帮", "门派", None, "graph")]
    got = linking.link("靖哥哥就是郭靖，丐帮的人", entries)
    assert [(m.name, m.canonical, m.source, round(m.confidence, 3)) for m in got] == [("靖哥哥", "郭靖", "alias", 0.765), ("郭靖", "郭靖", "graph", 0.85), ("丐帮", "丐帮", "graph", 1.0)]
    assert [m.name for m in linking.link("靖哥哥就是郭靖，丐帮的人", entries, ("门派",))] == ["丐帮"] and linking.link("", entries) == []


def test_focus_starts_at_a_named_relative():
    people = [linking.Link(0, 2, "甲乙", "甲乙", "人物"), linking.Link(5, 7, "丙丁", "丙丁", "人物")]
    assert linking.focus("甲乙的义父丙丁的徒弟是谁", people, {})[0] == "丙丁的徒弟是谁"
    assert [(m.canonical, m.start) for m in linking.focus("甲乙的义父丙丁的徒弟是谁", people, {})[1]] == [("丙丁", 0)]
    assert linking.focus("甲乙和丙丁的徒弟是谁", people, {"甲乙": "戊己"})[1][0].canonical == "戊己"
    assert linking.focus("师父", [linking.Link(0, 2, "师父", "师父", "人物")], {}) == ("师父", [])


def test_the_lexicon_survives_its_source(spark):
    nodes = spark.createDataFrame([("人物", "郭靖", "射雕")], "label string, name string, era string")
    aliases = spark.createDataFrame([("靖哥哥", "郭靖", "人物", ["射雕"], "", "")], ALIAS)
    time, broken = [0.0], [False]

    def load():
        if broken[0]:
            raise OSError("down")
        return nodes

    cache = linking.LexiconCache(load, aliases, 10, 5, lambda: time[0])
    assert cache.get().count() == 2 and cache.get().count() == 2 and cache.loads == 1
    broken[0], time[0] = True, 11
    assert cache.get().count() == 2 and "down" in cache.degraded_reason
    broken[0], time[0] = False, 13
    cache.get()
    assert cache.loads == 1  # not tried again yet
    time[0] = 17
    assert cache.get().count() == 2 and cache.loads == 2 and not cache.degraded_reason
    broken[0] = True
    cache.invalidate()
    assert [r["source"] for r in cache.get().collect()] == ["alias"]


def provider():
    def letters(texts):  # pickled by value, as executors do not have this module
        return [[float(t.count(c)) for c in "abc"] for t in texts]

    return letters


letters = provider()


def test_providers(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "aab", "x"), ("2", "ccc", "y"), ("3", "aab", None), ("4", "", "")], "chunk_id string, text string, era string")
    embedder = retrieval.Embedder(letters, "letters")
    meta = retrieval.build_index(chunks, embedder, str(tmp_path / "i"))
    assert meta == {"kind": "remote", "model": "letters", "dimension": 3, "fingerprint": "remote:letters:3"} and retrieval.read_meta(spark, str(tmp_path / "i"))["dimension"] == 3
    best = retrieval.search(spark, str(tmp_path / "i"), "aab", retrieval.Embedder(letters, "letters"), 3)
    assert [(r["chunk_id"], r["score"]) for r in best.collect()] == [("1", 1.0), ("3", 1.0), ("2", 0.0)]
    assert [r["chunk_id"] for r in retrieval.search(spark, str(tmp_path / "i"), "aab", embedder, 2, "y").collect()] == ["3"]
    assert [r["chunk_id"] for r in retrieval.search(spark, str(tmp_path / "i"), "aab", embedder, 2, "y", True).collect()] == ["3", "2"]
    with pytest.raises(retrieval.Unavailable):
        retrieval.search(spark, str(tmp_path / "i"), "aab", retrieval.Embedder(letters, "other"))
    rows, why = retrieval.embed_and_search(spark, str(tmp_path / "none"), "aab", embedder, chunks, 1)
    assert rows.first()["chunk_id"] == "1" and "Unavailable" in why
    with pytest.raises(retrieval.Unavailable):
        retrieval.embed_and_search(spark, str(tmp_path / "none"), "aab", embedder)
    assert retrieval.search_chunks(chunks, "x", embedder, 0).count() == 0


def test_failing_providers(spark):
    class AuthenticationError(Exception):
        pass

    calls = []

    def twice(texts):
        calls.append(1)
        if len(calls) < 2:
            raise ConnectionError
        return letters(texts)

    assert retrieval.asked(twice, ["a"], 2) == [[1.0, 0.0, 0.0]] and len(calls) == 2

    def denied(texts):
        calls.append(1)
        raise AuthenticationError

    with pytest.raises(retrieval.EmbeddingError):
        retrieval.asked(denied, ["a"], 5)
    assert len(calls) == 3
    for bad in ([[float("nan")]], [[1.0], [1.0, 2.0]], [[]], []):
        with pytest.raises(retrieval.EmbeddingError):
            retrieval.checked(bad, max(1, len(bad)), None)

    def down(texts):
        raise ConnectionError("down")

    rows = spark.createDataFrame([("1", "ab"), ("2", "")], "k string, t string")
    with pytest.raises(retrieval.EmbeddingError):
        retrieval.Embedder(down, "m", attempts=1).embed(rows, "k", "t")
    with pytest.raises(retrieval.EmbeddingError):
        retrieval.Embedder(down, "m", 3, 1, True).embed(rows, "k", "t")
    local = retrieval.Embedder(down, "m", attempts=1, fallback=True)
    assert {len(r["embedding"]) for r in local.embed(rows, "k", "t").collect()} == {256} and local.degraded and local.spec["kind"] == "local-hash"


def test_texts_by_any_name(spark):
    df = spark.createDataFrame([(" ", "b", None), (None, None, "c")], "text string, content string, page_content string")
    assert [r[0] for r in df.select(retrieval.text_of(df)).collect()] == ["b", "c"]


def test_runs_do_not_end_with_a_question(spark):
    class Engine:
        def __init__(self, spark):
            self.spark = spark

        def ask(self, question, method, k):
            raise OSError("down")

    got = evaluate.run(Engine(spark), [{"id": "1", "question": "q", "acceptable_answers": ["a"]}, {"id": "2", "question": "q"}], done=["2"]).collect()
    assert [(r["id"], r["status"], r["hit"], r["error"]) for r in got] == [("1", "error", False, "OSError: down")]


def test_scopes_and_wiping(spark, tmp_path):
    nodes = spark.createDataFrame([("人物", "a", "射雕"), ("门派", "b", None)], "label string, name string, era string")
    assert match.scoped_nodes(nodes).count() == 2 and match.scoped_nodes(nodes, ["射雕"]).count() == 1 and match.scoped_nodes(nodes, labels=("门派",)).first()["name"] == "b"
    for name in ("t", "t-index", "t-state"):
        spark.range(1).write.parquet(str(tmp_path / name))
    assert maintain.wipe(spark, str(tmp_path / "t"), True, True, True) and not any((tmp_path / n).exists() for n in ("t", "t-index", "t-state"))
