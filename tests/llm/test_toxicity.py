import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import toxicity as X

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, toxic string, Score int"


def test_score_is_the_most_toxic_window():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=X.BUCKETS)
    m = X.Model(weights, -0.3)
    for text in ("one", "One two, TWO three", "x" * 300 + " é", " ".join(f"w{chr(97 + i % 26)}" for i in range(40)), "a b c d e f g"):
        own = X.words(text)
        value = [np.mean([weights[b] for b in X.bag(w)]) for w in own]
        starts = {0} if len(own) <= X.WINDOW else {*range(0, len(own) - X.WINDOW + 1, X.STEP), len(own) - X.WINDOW}
        best = max(np.mean(value[i : i + X.WINDOW]) for i in starts)
        assert m.score(text) == pytest.approx(1 / (1 + np.exp(-(best - 0.3)))) and m.score(text) == m.score(text)


def test_defined_cases(spark):
    bad, good = [(i, f"you {w} fool number", "1", 1) for i, w in enumerate(["stupid"] * 30)], [(100 + i, "kind words of thanks", "0", 1) for i in range(30)]
    docs = spark.createDataFrame([*bad, *good, (500, None, "1", 1), (501, "", "0", 1)], SCHEMA)
    labels = docs.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.lit("x").alias("TEXT")).union(spark.createDataFrame([(None, 1, "x"), (3, None, "x"), (9999, 0, "x"), (4, 7, "x")], "doc_id long, toxic int, TEXT string"))
    model = X.train(docs, labels)
    rows = spark.createDataFrame([(1, None, "", 1), (2, "", "", 1), (3, "12 ?", "", 1), (4, "stupid fool", "", 1), (4, "stupid fool", "", 1), (None, "thanks", "", None), (6, "stupiid foool", "", 1), (7, "kind thanks " * 100_000, "", 1)], SCHEMA)
    out = X.scored(rows, model).collect()
    score = {r.doc_id: r.score for r in out}
    assert len(out) == 8 and score[1] == score[2] == score[3] <= 0.5 and score[4] > 0.7 and score[6] > 0.7 and score[None] < 0.3 and score[7] < 0.3
    assert {r.score for r in X.scored(rows, X.train(docs, labels.filter("toxic = 1"))).collect()} == {0.0}
    assert X.scored(rows.limit(0), X.train(docs.limit(0), labels.limit(0))).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = X.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").join(docs, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in out)
    toxic, clean = [r for r in out if r.toxic], [r for r in out if not r.toxic]
    caught, wrong = sum(r.predicted for r in toxic) / len(toxic), sum(r.predicted for r in clean) / len(clean)
    assert caught > 0.75 and wrong < 0.02, (caught, wrong)
    assert all(r.predicted == (r.score >= 0.7) for r in out)


def test_plain_average_is_an_option():
    rng = np.random.default_rng(2)
    clean, bad = ["kind", "words", "of", "thanks", "number", "river"], ["stupid", "fool"]
    texts = [[str(rng.choice(clean)) for _ in range(40)] + (list(rng.choice(bad, 4)) if k % 2 else []) for k in range(80)]
    m = X.fit(texts, np.arange(80) % 2, window=None)
    for t in texts[:10]:
        mean = np.mean([np.mean([m.weights[b] for b in X.bag(w)]) for w in t])
        assert m.score(" ".join(t)) == pytest.approx(1 / (1 + np.exp(-(mean + m.bias))))
    assert all((m.score(" ".join(t)) > 0.5) == bool(k % 2) for k, t in enumerate(texts))


def test_every_start_of_a_window_counts():
    m = X.Model(np.random.default_rng(4).normal(size=X.BUCKETS), 0.1)
    own = [f"w{chr(97 + i)}" for i in range(20)]
    value = [np.mean([m.weights[b] for b in X.bag(w)]) for w in X.words(" ".join(own))]
    best = max(np.mean(value[i : i + X.WINDOW]) for i in range(20 - X.WINDOW + 1))
    assert m.score(" ".join(own)) == pytest.approx(1 / (1 + np.exp(-(best + 0.1))))
