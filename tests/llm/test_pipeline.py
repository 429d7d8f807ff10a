import pytest

import corpus_pipeline as pipeline
from ledgerspark.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        counts.append(docs.count())
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").distinct().collect()}
        else:
            assert docs.columns == columns
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]


def test_run_gives_the_last_stage(spark):
    assert "sequence_id" in pipeline.run(spark, SF).columns


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, size long, _row string, key string, kind int"


def awkward(spark):
    long = " ".join(f"word{i} walks." for i in range(20_000))
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, "a word", None, "b", 6), (3, "a word", None, "b", 6), (None, "x y z", "en", "a", 5), (3, "quite another text under that id", "en", "b", 32), (9, long, "en", "a", len(long))]
    return spark.createDataFrame([(*r, 7, "clash", None, 1) for r in rows], AWKWARD), long


@pytest.mark.parametrize("stage", pipeline.STAGES, ids=lambda s: s[0])
def test_awkward_rows(spark, stage):
    name, function = stage
    docs, long = awkward(spark)
    got = function(spark, docs, SF).collect()
    assert function(spark, docs.limit(0), SF).count() == 0
    if name == "packing":
        assert sorted((r.doc_id or 0, r.doc_tokens) for r in got if r.start == 0)[1:3] == [(1, 1), (2, 1)]
        assert len({(r.doc_id, r.doc_tokens) for r in got if r.start == 0}) == 6
        assert sum(r.length for r in got if r.doc_id == 9) == next(r.doc_tokens for r in got if r.doc_id == 9)
        return
    assert function(spark, docs, SF).columns == pipeline.COLUMNS
    texts = sorted(((r.doc_id or 0, r.text or "", r.n_chars) for r in got), key=str)
    all_ = sorted(((r.doc_id or 0, r.text or "", r.n_chars) for r in docs.collect()), key=str)
    if name in ("toxicity", "line_dedup"):
        assert texts == all_
    elif name == "near_dedup":
        # null and empty texts are one class, repeated rows another
        assert texts == sorted(((d, t, n) for d, t, n in set(all_) if d != 2), key=str)
    else:
        sizes = {}
        for r in got:
            sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
        assert set(texts) <= set(all_) and 0 < sizes["b"] <= 3 * 10 and all(texts.count(t) <= 3 * all_.count(t) for t in set(texts))
        assert sum(t == long for _, t, _ in texts) <= 3


def test_pipeline_against_its_stages_one_by_one(spark):
    """run() gives the rows of the stages applied in turn, and each stage's decisions hold in what follows."""
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert kept["near_dedup"] <= kept["line_dedup"] == kept["toxicity"]
    assert kept["packing"] == kept["mixing"] <= kept["near_dedup"]
    whole = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.where("start = 0").collect())
    assert {r[0] for r in whole(pipeline.run(spark, SF))} == {r[0] for r in whole(docs)}
