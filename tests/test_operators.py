import random
import shutil

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import sequential
from weftgraph.operators import align, answer, extract, graph, match, stats, store, vectors
from weftgraph.schema import EDGE, NODE
from weftgraph.sources import files
from weftgraph.streaming import ingest


def edges(spark, *pairs, kind="ENEMY_OF"):
    return spark.createDataFrame([(kind, "人物", a, "人物", b, []) for a, b in pairs], "type string, src_label string, src string, dst_label string, dst string, chunk_ids array<string>")


def test_paths(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"))
    found = {r["name"]: (r["distance"], r["path"]) for r in graph.bfs(e, "a", 4).collect()}
    assert found == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "x": (1, ["a", "x"]), "c": (2, ["a", "b", "c"]), "d": (3, ["a", "b", "c", "d"])}
    assert graph.shortest_path(e, "a", "d", 2).count() == 0
    assert graph.shortest_path(e, "a", "a").first()["distance"] == 0


def test_ranks_sum_to_one(spark):
    names = spark.createDataFrame([(x,) for x in "abcdz"], "name string")
    ranks = graph.pagerank(names, edges(spark, ("a", "b"), ("b", "c"), ("b", "d"), ("b", "a")))
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1, abs=1e-6)
    assert ranks.orderBy(F.desc("rank")).first()["name"] == "b"


def test_communities(spark):
    two = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x"))
    found = {r["name"]: r["community"] for r in graph.louvain(two).collect()}
    assert len({found[v] for v in "abc"}) == 1 and len({found[v] for v in "xyz"}) == 1 and found["a"] != found["x"]
    assert graph.louvain(edges(spark, ("a", "b")).where("false")).count() == 0


def test_parallel_communities(spark):
    assert graph.communities(edges(spark, ("a", "b")).where("false")).count() == 0
    rng = random.Random(3)
    pairs = {tuple(sorted(p)) for g in range(5) for _ in range(60) for p in [rng.sample([f"{g}{i:02}" for i in range(15)], 2)]}
    pairs |= {tuple(sorted((f"{rng.randrange(5)}{rng.randrange(15):02}", f"{rng.randrange(5)}{rng.randrange(15):02}"))) for _ in range(30)}
    e = edges(spark, *sorted(pairs))
    one = graph.louvain(e).select("name", F.col("community").cast("string").alias("community"))
    assert graph.modularity(e, graph.communities(e)) > 0.85 * graph.modularity(e, one) > 0.4


def test_traversal_is_simple_and_complete(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), kind="SPOUSE_OF").unionByName(edges(spark, ("p", "b"), ("b", "k"), kind="PARENT_OF"))
    plan = [("SPOUSE_OF", "both"), ("PARENT_OF", "in")]
    assert [r["names"] for r in match.traverse(e, "a", plan).collect()] == [["a", "b", "p"]]
    assert match.traverse(e, "a", [*plan, ("MASTER_OF", "in")]).count() == 0
    assert match.traverse(e, "a", plan, targets={1: "q"}).count() == 0


def test_merge_keeps_the_first_and_the_longest(spark):
    rows = spark.createDataFrame(
        [(1, "人物", "a", "射雕", "B1", "x", None, None), (2, "人物", "a", "神雕", "B2", "xyz", "", None), (3, "人物", "a", None, "B1", "abc", "L", None)],
        "ord long, label string, name string, era string, book string, description string, location string, art_type string")
    r = store.merge_nodes(rows.unionByName(rows).repartition(3)).first()
    assert (r["era"], r["description"], r["location"], r["eras"], r["books"]) == ("射雕", "xyz", "L", ["射雕", "神雕"], ["B1", "B2"])


def test_alias_chains_and_cycles(spark):
    d = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("w", "x")], "alias string, canonical string")
    assert sorted(map(tuple, store.flatten_aliases(d).collect())) == [("a", "c", True), ("b", "c", False)]
    long = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(40)], "alias string, canonical string")
    assert {tuple(r) for r in store.flatten_aliases(long).collect()} == {(f"n{i:02}", "n40", i < 39) for i in range(40)}
    assert store.flatten_aliases(d.where("false")).count() == 0


def test_lines_within_budget(spark):
    lines = spark.createDataFrame([("k", i, x) for i, x in enumerate(["aaaa", "bb", "aaaa", "cccccccc", "d"])], "key string, o int, line string")
    assert [r["line"] for r in stats.within_budget(lines, "key", "o", "line", 8).orderBy("o").collect()] == ["aaaa", "bb"]
    assert stats.within_budget(lines, "key", "o", "line", 1).count() == 1


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, [2.0, 0.0])], "vec_id int, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in vectors.top_k(v, [1.0, 0.0], 3).collect()] == [(1, 1.0), (5, 1.0), (2, 0.0)]
    assert vectors.top_k(v, [1.0, 0.0], 0).count() == 0
    assert [r[0] for r in v.select(vectors.valid_vector(F.col("embedding"), 2)).collect()] == [True, True, True, False, True]


def test_ancestors(spark):
    n = spark.createDataFrame([("杨过", "杨康之子，武功高"), ("杨康", ""), ("郭芙", "郭靖的女儿")], "name string, description string")
    found = align.known_ancestors(align.ancestors(n), n)
    assert sorted(map(tuple, found.select("ancestor", "descendant", "kind", "reason").collect())) == [("杨康", "杨过", "之子", None), ("郭靖", "郭芙", "之女", "no_ancestor")]


def test_methods_are_registered_once():
    assert {"master_chain", "sect_agg", "art_lineage", "person_relation", "cross_novel"} <= set(answer.METHODS)
    with pytest.raises(ValueError):
        answer.register("sect_agg")(print)


def test_chain_and_path_rules(spark):
    q = spark.createDataFrame([("甲的师父的师父",), ("甲的太师父",), ("甲的徒弟",)], "q string")
    assert [r[0] for r in q.select(answer.chain_length(F.col("q"))).collect()] == [2, 3, 1]
    p = spark.createDataFrame([([("a", "b"), ("b", "c")],), ([("a", "b"), ("x", "c")],), ([("a", "b")],)], "p array<struct<source:string,target:string>>")
    assert [r[0] for r in p.select(answer.path_valid(F.col("p"))).collect()] == [True, False, True]


def test_prompts_and_empty_payloads(spark):
    df = spark.createDataFrame([("1", "甲教乙。", "none"), ("2", "x", '{"entities": []}')], "chunk_id string, text string, answer string")
    asked = df.select(extract.prompt(F.col("text")).alias("p")).first()["p"]
    assert "甲教乙。" in asked and all(t in asked for t in ("MASTER_OF", "BRANCHED_FROM", "人物", "内功"))
    got = {r["chunk_id"]: r["payload"] for r in extract.payload_or_empty(extract.parse(df)).collect()}
    assert got["1"]["entities"] == [] and got["1"]["relationships"] == []


def test_names_may_sound_alike(spark):
    df = spark.createDataFrame([("abcd", "abxy")], "a string, b string")
    score = lambda sound=None: df.select(sequential.name_scores(F.col("a"), F.col("b"), sound)).first()[0]
    assert score() == 0.5 and score(lambda x: x[:2]) == 1.0


def test_chains_keep_their_edges(spark):
    e = spark.createDataFrame([("MASTER_OF", "人物", "a", "人物", "b", ["c1"], ["q"]), ("MASTER_OF", "人物", "b", "人物", "c", [], [])], EDGE.split(", eras")[0])
    r = answer.master_chain(e, "c", 2, "in").first()
    assert (r["names"], r["depth"], [x["chunk_ids"] for x in r["rels"]]) == (["c", "b", "a"], 2, [[], ["c1"]])


def test_a_failing_provider_can_be_retried(spark):
    def provider(text):
        if text == "bad":
            raise ValueError
        return '{"entities": [], "relationships": []}'

    class AuthenticationError(Exception):
        pass

    def denied(text):
        raise AuthenticationError("no")

    chunks = spark.createDataFrame([("1", "bad"), ("2", "good")], "chunk_id string, text string")
    tried = {r["chunk_id"]: r["attempts"] for r in extract.ask(chunks, provider, 2).collect()}
    assert tried == {"1": 2, "2": 1}
    gone = extract.parse(extract.ask(chunks, denied)).collect()
    assert {(r["status"], r["attempts"]) for r in gone} == {("fatal", 1)}
    assert {r["chunk_id"]: r["status"] for r in extract.parse(extract.ask(chunks, provider)).collect()} == {"1": "retryable", "2": "empty"}


def test_books_to_chunks(spark, tmp_path):
    (tmp_path / "射雕英雄传.txt").write_bytes("第一回 起\r\n 甲来。 \r\n\r\n第二回 承\r\n乙去。".encode("gb18030"))
    books = files.read_books(spark, str(tmp_path))
    got = [tuple(r) for r in files.chunk_books(books).select("logical_id", "era", "chapter", "text").orderBy("logical_id").collect()]
    assert got == [("射雕英雄传::0", "射雕", "第一回 起", "甲来。"), ("射雕英雄传::1", "射雕", "第二回 承", "乙去。")]


def test_question_files_are_checked(spark, tmp_path):
    f = tmp_path / "q.json"
    f.write_text('[{"id":"1","question":"q","category":"c","answer_entities":["a"]},{"id":"1","question":"q","category":"c","answer_entities":["a"]}]')
    with pytest.raises(files.DataError):
        files.read_questions(spark, str(f))


def test_logs_count_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": "1"}\n\nnot json\n')
    assert sorted((r["id"], r["valid"]) for r in files.read_log(spark, str(tmp_path / "log.jsonl"), "id string").collect() if r["valid"]) == [("1", True)]
    assert files.read_log(spark, str(tmp_path / "log.jsonl"), "id string").count() == 2


def test_backup_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("人物", "a", None, None, ["射雕"], [], None, None, None, [])], NODE)
    e = spark.createDataFrame([("ENEMY_OF", "人物", "a", "人物", "b", ["1"], [], [], [], None)], EDGE)
    before = files.backup(n, e, str(tmp_path / "b"))
    n2, e2 = files.restore(spark, str(tmp_path / "b"))
    assert files.verified(before, files.counts(n2, e2)) and n2.first() == n.first() and e2.first() == e.first()


def test_stream_merges_each_file_once(spark, tmp_path):
    where = str(tmp_path)
    schema = spark.createDataFrame([], "k string, n int").schema
    for i, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{where}/in/{i}")
        assert ingest.upsert(spark, f"{where}/in/*", schema, f"{where}/out", f"{where}/cp", "k", ["n"]) == 1
    assert ingest.upsert(spark, f"{where}/in/*", schema, f"{where}/out", f"{where}/cp", "k", ["n"]) == 0
    assert sorted(map(tuple, ingest.merged(spark, f"{where}/out", schema).collect())) == [("a", 2), ("b", 1)]
    # A table whose state is lost is not begun anew, as rows merged before would be lost without a word.
    shutil.rmtree(f"{where}/out/current")
    spark.createDataFrame([("c", 3)], schema).write.parquet(f"{where}/in/2")
    with pytest.raises(Exception, match="follows nothing"):
        ingest.upsert(spark, f"{where}/in/*", schema, f"{where}/out", f"{where}/cp", "k", ["n"])


def test_streams_leave_late_events_out(spark, tmp_path):
    where = str(tmp_path)
    schema = "ts string, event_type string, user_id long"
    days = [["2024-01-01 10:00:00", "2024-01-09 10:00:00"], ["2024-01-01 11:00:00", "2024-01-09 12:00:00"], ["2024-01-20 00:00:00"]]
    results: dict[str, dict] = {"counts": {}, "sessions": {}}
    for i, rows in enumerate(days):
        spark.createDataFrame([(t, "x", 1) for t in rows], schema).coalesce(1).write.parquet(f"{where}/in/{i}")
        for name, made in (("counts", lambda e: ingest.windowed_counts(e, late="2 days")), ("sessions", lambda e: ingest.sessions(e, "3 hours", "2 days"))):
            events = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"{where}/in/*")

            def keep(batch, n, name=name):
                for r in batch.collect():
                    results[name][str(r["begin"])] = r["n"]

            made(events).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{where}/cp-{name}").trigger(availableNow=True).start().awaitTermination()
    assert results["counts"] == {"2024-01-01 00:00:00": 1, "2024-01-09 00:00:00": 2}
    assert results["sessions"] == {"2024-01-01 10:00:00": 1, "2024-01-09 10:00:00": 2}
