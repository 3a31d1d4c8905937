import os

import pytest

import corpus_pipeline
from nearfield.llm import exact_dedup, quality, queries, simhash
from nearfield.llm.common import BATCH, BATCH_SETTING, table
from tests.llm.test_dedup import LOWER, brute_similar

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_each_stage_by_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        texts = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            model = quality.learn_quality(before, table(spark, SF, "labels"))
            assert sorted(kept[name]) == sorted(r.doc_id for r in quality.score_quality(before, model).collect() if r.predicted)
        elif name == "exact_dedup":
            last = {}
            for i, t in texts.items():
                last[t.translate(LOWER)] = max(i, last.get(t.translate(LOWER), i))
            assert sorted(kept[name]) == sorted(last.values())
        elif name == "near_dedup":
            want = brute_similar(list(texts.items()))
            missed = set(kept[name]) - {min(g) for g in want.values()}
            assert {min(g) for g in want.values()} <= set(kept[name]) and len(missed) <= 1  # a link at the very threshold may be missed
        elif name == "mixing":
            assert set(kept[name]) == set(texts) and max(map(kept[name].count, texts)) == 2
        else:
            assert set(kept[name]) == set(texts)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_rows_without_an_id_and_repeated_ids_follow_the_decision(spark):
    words = "one two three four five six seven eight nine ten"
    rows = [(None, words), (None, words.upper()), (4, words), (None, "no id at all"), (None, "No id at all"), (7, "another text"), (7, "yet one more"), (9, "yet one more"), (8, "the same row"), (8, "the same row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [("4", words), ("7", "another text"), ("8", "the same row"), ("9", "yet one more"), ("None", "no id at all")]
    out = corpus_pipeline.drop_exact(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in out) == want
    want[3] = ("7", "yet one more")  # the smallest id here
    out = corpus_pipeline.drop_near(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in out) == sorted(want)


def test_run_ends_with_pieces(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_workers_get_whole_texts_in_small_batches(spark):
    text, before = "some words of a long text " * 800, spark.conf.get(BATCH_SETTING)
    docs = spark.createDataFrame([(i, f"{text}{i}", f"s{i % 2}") for i in range(800)], "doc_id long, text string, source string").coalesce(1)
    sizes = docs.mapInPandas(lambda batches: (b.assign(n=b["text"].str.len().sum())[["n"]].head(1) for b in batches), "n long")
    try:
        for stage in (corpus_pipeline.drop_near, corpus_pipeline.mix_sources, corpus_pipeline.pack):
            spark.conf.set(BATCH_SETTING, "64m")
            stage(spark, docs.limit(2), SF)
            assert max(r.n for r in sizes.collect()) <= BATCH + 2 * len(text)
        spark.conf.set(BATCH_SETTING, "1000b")
        corpus_pipeline.mix_sources(spark, docs.limit(2), SF)
        assert spark.conf.get(BATCH_SETTING) == "1000b"
    finally:
        spark.conf.set(BATCH_SETTING, before)


def test_exact_duplicates_write_no_list_of_clashing_hashes_where_there_are_none(spark, monkeypatch):
    written = []
    monkeypatch.setattr(exact_dedup, "cut", lambda df: written.append(df.columns) or df.checkpoint())
    docs = spark.createDataFrame([(1, "One text."), (2, "one text."), (3, "Another text.")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.exact_duplicates(docs).where("kept").collect()) == [2, 3]
    assert ["h"] not in written and len(written) == 2


def test_native_operators_run_no_python(spark):
    docs = table(spark, SF, "documents")
    assert not hasattr(exact_dedup, "np") and simhash is not None
    plan = queries.op8_merkle(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "Python" not in exact_dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
