import pytest
import tiktoken
from brute import components, secrets

import corpus_pipeline
import public_tokenizers
from weftgraph.llm import bpe, langid

SF = "/root/testdata/sf0.001"


def test_stage_by_stage_against_plain_versions(spark):
    """Each stage is held against a plain version on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = langid.fit(docs)
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}

    known = corpus_pipeline.language_id(spark, docs, SF)
    assert known.columns == columns
    kept = {i: r for i, r in rows.items() if model.predict(r["text"])[2]}
    assert {r["doc_id"]: r.asDict() for r in known.collect()} == kept and len(kept) > 0.97 * len(rows)

    single = corpus_pipeline.near_duplicates(spark, known, SF)
    best = components([(i, r["text"]) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if best[i] == i}
    assert single.columns == columns and {r["doc_id"]: r.asDict() for r in single.collect()} == kept

    clean = corpus_pipeline.decontamination(spark, single, SF)
    passages = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: r for i, r in kept.items() if not any(p in r["text"] for p in passages)}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == set(kept)

    safe = corpus_pipeline.secret_scan(spark, clean, SF)
    got = {r["doc_id"]: r for r in safe.collect()}
    assert safe.columns == columns and set(got) == set(kept)
    for i, r in got.items():
        found = secrets(kept[i]["text"])
        assert (r["text"] == kept[i]["text"]) == (not found) and not secrets(r["text"]) and r["n_chars"] == (len(r["text"]) if found else kept[i]["n_chars"])

    last = {r["doc_id"]: r for r in corpus_pipeline.byte_bpe(spark, safe, SF).collect()}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.Vocabulary(f.read()).rank
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {i: list(r["ids"]) for i, r in last.items()} == {i: library.encode_ordinary(r["text"]) for i, r in got.items()}

    whole = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {i: list(r["ids"]) for i, r in last.items()}


def key(rows):
    return sorted(((r["doc_id"] is not None, r["doc_id"], r["text"] is not None, r["text"]) for r in rows), key=str)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, docs, name, stage):
    """Nulls, empty and long texts, repeats, ties and clashing columns have the results that the docstrings state."""
    rows = docs.collect()
    out = stage(spark, docs, SF)
    got = out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    if name == "language_id":
        model = langid.fit(docs)
        assert key(got) == key([r for r in rows if model.predict(r["text"])[2]]) and not {1, 2, 3, 8} & {r["doc_id"] for r in got}
    elif name == "near_duplicates":
        best = components([(r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] is not None])
        assert sorted((r["doc_id"] for r in got), key=str) == sorted([None, *{i for i, low in best.items() if i == low}], key=str)
    elif name == "decontamination":
        assert key(got) == key(rows)  # none of them holds a passage
    elif name == "secret_scan":
        hit = [r for r in rows if secrets(r["text"] or "")]
        assert len(got) == len(rows) and {r["doc_id"] for r in hit} == {12}
        assert key([r for r in got if r["doc_id"] != 12]) == key([r for r in rows if r["doc_id"] != 12])
    else:
        assert sorted((r["doc_id"] for r in got), key=str) == sorted((r["doc_id"] for r in rows), key=str)
        assert all((r["n_tokens"] == 0) == (r["doc_id"] in (1, 2)) and r["n_tokens"] == len(r["ids"]) for r in got)
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_the_whole_pipeline_takes_odd_rows(spark, tmp_path, docs):
    """Every column may be null in every row, and the tables may be empty."""
    for name, some in (("odd", docs), ("none", docs.where("false")), ("null", docs.limit(3).selectExpr(*[f"CAST(NULL AS {t}) AS `{c}`" for c, t in docs.dtypes]))):
        where = f"file://{tmp_path}/{name}"
        some.coalesce(1).write.parquet(f"{where}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{where}/benchmark.parquet")
        out = corpus_pipeline.run(spark, where)
        assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() <= some.count()
