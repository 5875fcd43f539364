import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import lm as M
from readloom.llm import pieces as P
from readloom.llm.common import fold

SCHEMA = "doc_id long, text string, WORD int, c string"
ROWS = [(i, " ".join(f"w{(i * k) % 11}" for k in range(i % 7)), 1, "x") for i in range(40)] + [(7, "Twice TWICE rare", 1, "x"), (7, "Twice TWICE rare", 1, "x"), (None, "no id w1", None, None), (50, None, 1, "x"), (51, "", 1, "x"), (52, "é ▁ ab\x00c \x1f", 1, "x"), (53, "w1 " * 50_000 + "x" * 30_000, 1, "x")]


def low(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def learns(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1


def brute_base(rows):
    counts = Counter(w for d, t, *_ in rows if learns(d) for w in low(t))
    ends = sum(learns(r[0]) for r in rows)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for d, t, *_ in rows:
        cs = [counts[w] for w in low(t)] + [ends]
        out.append((d, len(cs), sum(c > 0 for c in cs), n, sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in cs)))
    return out


def marginal(v, log, word):
    """Sum over all segmentations, by enumeration of prefixes."""
    scores = {p: log[i] for p, _, i in v.pieces}
    covered = set(scores)
    total = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            p = scores.get(word[i:j])
            if p is None and j == i + 1 and word[i] not in covered:
                p = sum(log[v.byte_ids[b]] for b in (P.BLANK if word[i] == P.FOREIGN else word[i]).encode())
            if p is not None:
                total[j] += total[i] * math.exp(p)
    return math.log(total[-1]) if total[-1] else -math.inf


def toy():
    scores = {"▁": -2.0, "▁w": -3.0, "w": -4.0, "1": -3.0, "w1": -3.5, "▁w1": -4.5, "a": -4.0, "ab": -5.0, "b": -4.5, "r": -4.0, "ra": -5.0, "e": -3.0, "▁t": -5.0, "x": -5.0, "xx": -6.0}
    return P.Vocabulary([(p, s, 10 + i) for i, (p, s) in enumerate(scores.items())], {b: 1000 + b for b in range(256)}, 1300)


@pytest.mark.parametrize("hot", [M.HOT, 20])
def test_scores_are_brute_force(spark, hot):
    v, docs = toy(), spark.createDataFrame(ROWS, SCHEMA)
    got = M.scored(docs, v, fold("doc_id", 5) != 1, hot=hot).collect()
    key = lambda r: (str(r[0]), *r[1:4], round(r[4], 4))
    assert sorted(key((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score)) for r in got) == sorted(map(key, brute_base(ROWS)))
    counts = Counter(w for d, t, *_ in ROWS if learns(d) for w in low(t))
    ends = sum(learns(r[0]) for r in ROWS)
    expect = np.zeros(v.size)
    for w, c in counts.items():  # expected uses by all segmentations, from how the marginal changes with each score
        for _ in [0] if len(w) < 40 else []:
            s = M.spelled(w.encode())
            base = {i: x for i, x in v.log.items()} | {i: v.floor for i in v.byte_ids.values()}
            whole = marginal(v, base, s)
            for i in base:
                expect[i] += c * (marginal(v, base | {i: base[i] + 1e-6}, s) - whole) / 1e-6 if i < 1000 or (i - 1000) in s.encode("utf-8", "replace") else 0
    long = [w for w in counts if len(w) >= 40]
    lattice = P.Lattice(v)
    lattice.forward([M.spelled(w.encode()) for w in long], expect, np.array([float(counts[w]) for w in long]))
    prior = {i: math.exp(s) for i, s in v.log.items()} | {i: 256 / (len(v.log) + 256) / 256 for i in v.byte_ids.values()}
    spread, total = M.PRIOR / sum(prior.values()), expect.sum() + M.PRIOR + ends + 1
    log = {i: math.log((expect[i] + spread * p) / total) for i, p in prior.items()}
    for d, t, *_ in ROWS:
        if t and len(t) > 1000:
            continue
        want = (sum(marginal(v, log, M.spelled(w.encode())) for w in low(t)) + math.log((ends + 1) / total)) / math.log(10)
        assert any(r.doc_id == d and r.score == pytest.approx(want, abs=2e-3) for r in got), (d, t, want)


def test_learns_from_the_corpus(spark):
    out = M.query(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d: rest for d, *rest in brute_base(rows)}
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert [r.n_tokens, r.n_known, r.train_tokens] == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.score < 0 and r.held_out == (not learns(r.doc_id))
    # A held-out text is likelier than the same text with its letters turned round.
    back = docs.select("doc_id", F.concat_ws(" ", F.transform(F.split("text", " "), F.reverse)).alias("text")).filter(fold("doc_id", 5) == 1)
    both = M.scored(docs.filter(fold("doc_id", 5) != 1).union(back), M.load(), fold("doc_id", 5) != 1).withColumnRenamed("score", "turned").join(out.filter("held_out"), "doc_id")
    rates = [r.score > r.turned for r in both.collect()]
    assert len(rates) > 100 and sum(rates) / len(rates) > 0.95


def test_empty(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert M.scored(docs.limit(0), toy(), F.lit(True)).collect() == []
    none = M.scored(docs, toy(), F.lit(False)).collect()
    assert len(none) == len(ROWS) and {(r.n_known, r.train_tokens) for r in none} == {(0, 0)} and all(math.isfinite(r.score) for r in none)


def test_many_null_ids_and_texts_of_one_kind(spark):
    docs = spark.createDataFrame([(None, None)] * 60 + [(1, None)] * 20 + [(2, "same words again")] * 40 + [(3, "Other words")], "doc_id long, text string")
    out = M.scored(docs, M.load(), F.lit(True)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in out if r.doc_id != 3) == sorted([(True, None, 1)] * 60 + [(False, 1, 1)] * 20 + [(False, 2, 4)] * 40) and len({r.score for r in out if r.doc_id == 2}) == 1
