import json

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import maintain, merge, retrieval, service
from weftgraph.schema import ALIAS, LABELS


@pytest.fixture(scope="module")
def engine(spark):
    nodes = spark.createDataFrame([("人物", "郭靖", "射雕"), ("人物", "黄蓉", "射雕"), ("人物", "黄药师", "射雕"), ("门派", "桃花岛", None), ("武功", "弹指神通", None)], "label string, name string, era string")
    rows = [("SPOUSE_OF", "人物", "郭靖", "人物", "黄蓉"), ("SPOUSE_OF", "人物", "黄蓉", "人物", "郭靖"), ("PARENT_OF", "人物", "黄药师", "人物", "黄蓉"), ("FOUNDER_OF", "人物", "黄药师", "门派", "桃花岛"), ("BELONGS_TO", "人物", "黄蓉", "门派", "桃花岛")]
    edges = spark.createDataFrame([(*r, ["c1"]) for r in rows], "type string, src_label string, src string, dst_label string, dst string, chunk_ids array<string>")
    chunks = spark.createDataFrame([("c1", "黄蓉是黄药师的女儿。"), ("c2", "欧阳锋练蛤蟆功。")], "chunk_id string, text string")
    return service.Engine(spark, nodes, edges, chunks)


def test_composite_relations(engine):
    r = engine.ask("郭靖的岳父是谁")
    assert (r.method, r.status, r.lines) == ("person_relation", "ok", ["郭靖 -> 黄蓉 -> 黄药师"])


def test_founders_and_members(engine):
    assert engine.ask("桃花岛的成员有哪些").lines == ["桃花岛：黄蓉"]
    assert engine.ask("黄药师创立了什么").lines == ["黄药师：桃花岛"]


def test_missing_graph_evidence_falls_back_to_text(engine):
    r = engine.ask("黄蓉的儿子是谁")
    assert (r.method, r.fallback_from, r.status) == ("vector", "person_relation", "ok")
    assert engine.ask("黄蓉的儿子是谁", "person_relation").status == "no_context"


def test_generator_failure_degrades(spark, engine):
    def down(question, context):
        raise OSError

    other = service.Engine(spark, engine.nodes, engine.edges, engine.chunks, down)
    r = other.ask("郭靖的妻子是谁")
    assert r.status == "degraded" and r.lines == ["郭靖 -> 黄蓉"] and r.notes["attempts"] == 1


def test_generators_are_tried_again():
    calls = []

    class RateLimitError(Exception):
        pass

    class BadRequestError(Exception):
        pass

    def flaky(question, context):
        calls.append(context)
        if len(calls) < 3:
            raise RateLimitError("busy")
        return " yes "

    def wrong(question, context):
        raise BadRequestError("no")

    assert service.generated(flaky, "q", "c") == ("yes", "ok", 3, "")
    assert service.generated(wrong, "q", "c")[1:3] == ("unavailable", 1)
    assert service.generated(lambda q, c: None, "q", "c")[1:3] == ("unavailable", 4)
    assert service.generated(flaky, "q", " ")[1] == "no_context"


def test_leaders_relatives_and_pairs(engine):
    r = engine.ask("桃花岛的掌门是谁")
    assert r.method == "sect_agg" and r.notes["leader_unsupported"] and r.lines == ["桃花岛：黄蓉"]
    r = engine.ask("郭靖的义父是谁", "person_relation")
    assert r.status == "no_context" and "义父" in r.notes["unsupported"]
    r = engine.ask("郭靖和黄药师有何关系")
    assert r.method == "cross_novel" and r.lines == ["郭靖 与 黄药师：一般关联，2"]
    r = engine.ask("黄药师的岳父是谁")
    assert r.seed_id == "人物::黄药师" and r.confidence == 1.0 and r.notes["plan"] == "SPOUSE_OF(both) -> PARENT_OF(in)"


def test_aliases_are_linked(spark, engine):
    aliases = spark.createDataFrame([("靖哥哥", "郭靖", "人物", ["射雕"], "", "")], ALIAS)
    other = service.Engine(spark, engine.nodes, engine.edges, engine.chunks, aliases=aliases)
    r = other.ask("靖哥哥的妻子是谁")
    assert r.lines == ["郭靖 -> 黄蓉"] and r.confidence == 0.9


def test_queries_with_parameters(engine):
    assert [r[0] for r in engine.query("SELECT dst FROM edges WHERE src = :name AND type = :type", {"name": "黄药师", "type": "PARENT_OF"}).collect()] == ["黄蓉"]
    assert engine.query("WITH n AS (SELECT name FROM nodes WHERE :eras IS NULL OR array_contains(:eras, era)) SELECT * FROM n", eras=["射雕"]).count() == 3
    assert engine.query("SELECT name FROM nodes WHERE :eras IS NULL OR array_contains(:eras, era)").count() == 5
    with pytest.raises(retrieval.Unavailable):
        engine.query("SELECT nothing FROM nowhere")


def test_health(spark, engine):
    h = engine.health()
    assert h["graph"] == "ok" and "vector" in h["methods"] and h["names_degraded"] == ""


@pytest.mark.parametrize("bad", ["", "  ", None, 3, "x" * 501])
def test_requests_are_checked(engine, bad):
    with pytest.raises(service.RequestError):
        engine.ask(bad)


def test_unknown_method(engine):
    with pytest.raises(service.RequestError):
        engine.ask("郭靖", "none")


@pytest.mark.parametrize("value,k", [(None, 5), ("x", 5), (0, 5), (-1, 5), (7, 7), ("8", 8), (99, 50)])
def test_top_k(value, k):
    assert maintain.top_k(value) == k


def test_scopes():
    assert maintain.scope_eras("射雕", ["神雕侠侣"]) == ["射雕"]
    assert maintain.scope_eras(None, ["神雕侠侣"]) == ["神雕"]
    assert maintain.scope_eras(None, ["x"]) is None


def test_groups_are_checked(spark):
    rows = maintain.checked_groups({"郭靖": ("人物", ["靖儿", "郭大侠"])}, LABELS)
    nodes = spark.createDataFrame([("人物", "郭靖", "射雕", "短"), ("人物", "靖儿", "神雕", "长一些"), ("人物", "黄蓉", None, None), ("武功", "靖儿", None, None)], "label string, name string, era string, description string")
    edges = spark.createDataFrame([("SPOUSE_OF", "人物", "靖儿", "人物", "黄蓉", ["c1"]), ("SPOUSE_OF", "人物", "郭靖", "人物", "黄蓉", ["c2"]), ("ENEMY_OF", "人物", "靖儿", "人物", "郭靖", []), ("MASTERS", "人物", "靖儿", "武功", "靖儿", ["c3"])],
                                  "type string, src_label string, src string, dst_label string, dst string, chunk_ids array<string>")
    n, e, report = merge.merge_groups(nodes, edges, rows)
    named = {(r["label"], r["name"]): r for r in n.collect()}
    assert set(named) == {("人物", "郭靖"), ("人物", "黄蓉"), ("武功", "靖儿")}
    r = named["人物", "郭靖"]
    assert (r["era"], r["eras"], r["description"], r["aliases"], r["first_seen_era"]) == ("射雕", ["神雕"], "长一些", ["靖儿"], "神雕")
    assert {(r["type"], r["src"], r["dst"]): r["chunk_ids"] for r in e.collect()} == {("SPOUSE_OF", "郭靖", "黄蓉"): ["c2"], ("MASTERS", "郭靖", "靖儿"): ["c3"]}
    assert [tuple(r) for r in report.collect()] == [("人物", "郭靖", 1, 1, 1, 1, 0)]
    odd = edges.unionByName(spark.createDataFrame([("LOVES", "人物", "靖儿", "人物", "黄蓉", [])], edges.schema))
    n, e, report = merge.merge_groups(nodes, odd, rows)
    assert n.count() == 4 and e.count() == 5 and report.first()["errors"] == 1 and report.first()["merged"] == 0
    assert {label for label, _ in merge.ALIAS_GROUPS.values()} <= set(LABELS) and len(maintain.checked_groups(merge.ALIAS_GROUPS, LABELS)) == 20
    for bad in ({"a": ("x", ["b"])}, {"a": ("人物", ["b"]), "c": ("人物", ["b"])}, {"a": ("人物", ["a"])}):
        with pytest.raises(ValueError):
            maintain.checked_groups(bad, LABELS)


def test_dictionary_names_stay_canonical(spark):
    nodes = spark.createDataFrame([("人物", "北丐", "射雕"), ("人物", "洪七公", "射雕"), ("人物", "洪七公真人", "射雕")], "label string, name string, era string")
    aliases = spark.createDataFrame([("北丐", "洪七公", "人物", ["射雕"], 1)], "alias string, canonical string, label string, applicable_eras array<string>, ord int")
    got = {(r["alias"], r["canonical"], r["source"]) for r in maintain.decisions(nodes, aliases).collect()}
    assert got == {("北丐", "洪七公", "dictionary")}


def test_state_and_index(tmp_path):
    f = str(tmp_path / "s.json")
    assert maintain.load_state(f) is None
    maintain.save_state(f, {"a": 1})
    assert maintain.load_state(f) == {"a": 1}
    (tmp_path / "s.json").write_text("{")
    assert maintain.load_state(f) is None
    maintain.check_index({"fingerprint": "k:m:2"}, "k", "m", 2)
    maintain.check_index(None, "k", "m", 2)
    with pytest.raises(ValueError):
        maintain.check_index({"fingerprint": "k:m:3"}, "k", "m", 2)


def test_wipe_needs_both_flags(spark, tmp_path):
    where = str(tmp_path / "t")
    spark.range(3).write.parquet(where)
    assert maintain.wipe(spark, where) and maintain.wipe(spark, where, apply=True)
    assert spark.read.parquet(where).count() == 3
    assert maintain.wipe(spark, where, True, True) and not maintain.wipe(spark, where)


def test_report(spark):
    text = service.report(spark.range(2).select("id", F.lit(None).cast("int").alias("n")), "T")
    assert text.splitlines() == ["# T", "", "| id | n |", "|---|---|", "| 0 | - |", "| 1 | - |"]


def test_reports_as_json(spark, engine):
    assert json.loads(service.report_json(spark.range(1), "T")) == {"title": "T", "rows": [{"id": 0}]}
    assert engine.link("郭靖")[0].as_dict()["confidence"] == 1.0
