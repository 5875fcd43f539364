from pyspark.sql import types as T

import corpus_pipeline as pipeline
from readloom.llm import decontaminate, langid, sentencepiece_codec
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_secrets import brute_base
from tests.llm.test_simhash import brute_classes, brute_print

SF = "/root/testdata/sf0.001"


def test_every_stage_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    assert [name for name, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "secrets", "encode"]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = {r.doc_id: r for r in out.collect()}
        if name == "language":
            model = langid.train(docs.filter(langid.fold("doc_id", 3) != 1))
            want = {d for d, r in rows.items() if (p := model.predict(r.text))[0] != "und" and p[1] >= 0.5}
        elif name == "near_duplicates":
            ids = sorted(rows)
            want = {d for d, c in zip(ids, brute_classes([(d, brute_print(rows[d].text)) for d in ids])) if d == c}
        elif name == "decontaminate":
            want = {d for d, r in rows.items() if not contaminated(r.text, items)[1]}
        else:
            want = set(rows)
        assert set(got) == want, name
        if name == "secrets":
            assert all(not brute_base(r.text) for r in got.values()) and all(r.n_chars == len(r.text or "") for r in got.values() if r.text)
            untouched = [d for d, r in got.items() if r.text == rows[d].text]
            assert len(untouched) > len(got) * 0.8
        elif name != "encode":
            assert all(got[d] == rows[d] for d in got)
        if name == "encode":
            own = sentencepiece_codec.load().encoder()
            assert all(r.piece_ids == own.encode(rows[d].text).tolist() and r.round_trip and r.n_tokens == len(r.piece_ids) for d, r in got.items())
        else:
            assert out.columns == columns
        rows, docs = got, out
    assert {r.doc_id for r in pipeline.run(spark, SF).collect()} == set(rows)


def test_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema.add("LANG_PRED", T.StringType()).add("hit", T.IntegerType())
    rows = [(1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, "x", 1), (None, "the end of a text in english", "en", "s", 5, None, None), (4, "word " * 100_000, None, None, None, "x", 1), (4, "word " * 100_000, None, None, None, "x", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            if name != "encode":
                assert out.columns == docs.columns and n <= docs.count()


def test_shared_items_do_not_reach_clean_documents(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = decontaminate.drop_documents(docs, items).count()
    assert 0.5 * docs.count() < kept < docs.count()
