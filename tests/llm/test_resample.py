import math
import zlib

import numpy as np
import pytest

from readloom.llm import resample as R

SCHEMA = "doc_id long, text string, KEY int, selected string"
ROWS = [(i, " ".join(f"w{(i * k) % 13}" for k in range(i % 9)), 1, "x") for i in range(60)] + [(60, None, 1, "x"), (61, "", 1, "x"), (7, "twice twice", 1, "x"), (7, "twice twice", 1, "x"), (None, "no id", None, None), (62, "long " * 100_000, 1, "x")]
TARGET = [(i,) for i in range(0, 60, 3)] + [(None,), (999,)]


def brute_counts(texts):
    out = np.zeros(R.BUCKETS)
    for t in texts:
        for b in buckets(t):
            out[b] += 1
    return out


def buckets(text):
    h = [zlib.crc32(w) for w in (text or "").encode().split()]
    pair = lambda a, b: ((a * 0x9E3779B97F4A7C15 + b) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 40) % R.BUCKETS
    return [x % R.BUCKETS for x in h] + [pair(a, b) for a, b in zip(h, h[1:])]


def test_weights_and_draw_are_brute_force(spark):
    docs, target = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(TARGET, "doc_id long")
    out = R.drawn(docs, target).collect()
    raw, hit = brute_counts([r[1] for r in ROWS]), brute_counts([r[1] for r in ROWS if (r[0],) in TARGET and r[0] is not None])
    ratio = np.log((hit + 1) / (hit.sum() + R.BUCKETS)) - np.log((raw + 1) / (raw.sum() + R.BUCKETS))
    want = sorted((str(d), round(float(sum(ratio[b] for b in buckets(t))), 6)) for d, t, *_ in ROWS)
    assert sorted((str(r.doc_id), round(r.log_weight, 6)) for r in out) == want
    keys = sorted((r.key for r in out), reverse=True)
    k = math.ceil(R.FRACTION * len(ROWS))
    assert all(r.selected == (r.key >= keys[k - 1]) for r in out) and sum(r.selected for r in out) >= k
    again = R.drawn(docs.repartition(3), target).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    other = R.drawn(docs, target, seed=2).collect()
    assert {(r.doc_id, r.key) for r in other} != {(r.doc_id, r.key) for r in out}


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], [-1.5, 0.0, 3.25, 3.25, 1e300, -1e300], [float(x) ** 3 / 7 for x in range(-300, 300)], [1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in {1, len(values) // 2 or 1, len(values)}:
        assert R.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_empty_and_no_target(spark):
    docs, target = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([], "doc_id long")
    out = R.drawn(docs, target).collect()
    assert {r.log_weight for r in out} == {0.0} and sum(r.selected for r in out) >= math.ceil(R.FRACTION * len(ROWS))
    assert R.drawn(docs.limit(0), target).collect() == []


def test_good_texts_weigh_more(spark):
    out = R.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rate = {r.quality: r.s / r.n for r in out.groupBy("quality").agg({"selected": "count"}).withColumnRenamed("count(selected)", "n").join(out.filter("selected").groupBy("quality").count().withColumnRenamed("count", "s"), "quality").collect()}
    assert rate[1] > rate.get(0, 0.0) + 0.2
