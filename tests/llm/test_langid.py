import math
import zlib

import pytest
from pyspark.sql import functions as F

from readloom.llm import langid as L

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, LANG_PRED int, score string"
TRAIN = [(i, t, lang, 1, "x") for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("the dog and the cat", "en"), ("le chat est sur le tapis", "fr"), ("le chien et le chat", "fr"), ("no language", None), (None, "en")] * 4)]


def brute(model_rows, prior, text, order=6):
    """model_rows: {(lang, entry): n}"""
    langs, best = sorted(prior), {}
    known = {e for _, e in model_rows}
    total = {(lang, e[0]): sum(n for (a, b), n in model_rows.items() if a == lang and b[0] == e[0]) for lang, e in model_rows}
    log = lambda lang, e: max(-7.0, math.log10(model_rows[lang, e] / total[lang, e[0]])) if (lang, e) in model_rows else -7.0
    for lang in langs:
        s = math.log10(prior[lang] / sum(prior.values()))
        for w in text.lower().split():
            if "0" + w in known:
                s += log(lang, "0" + w)
                continue
            for n in range(order, 0, -1):
                p = f" {w} " if n > 1 else w
                g = [f"{n}{p[i : i + n]}" for i in range(len(p) - n + 1) if f"{n}{p[i : i + n]}" in known]
                if g:
                    s += sum(log(lang, x) for x in g) / len(g)
                    break
        best[lang] = s
    top = max(langs, key=lambda x: (best[x], -langs.index(x)))
    return top, 1 / sum(10 ** (best[x] - best[top]) for x in langs)


def test_backoff_is_brute_force(spark):
    docs = spark.createDataFrame(TRAIN, SCHEMA)
    model = L.train(docs, min_count=1, per_language=10**9)
    rows = {}
    for _, t, lang, *_ in TRAIN:
        if t and lang:
            for w in t.split():
                for e in ["0" + w] + [g for n in range(1, 7) for g in L.grams(w, n)]:
                    rows[lang, e] = rows.get((lang, e), 0) + 1
    prior = {"en": 8, "fr": 8}
    for text in ("the cat", "le chat", "chats", "thee", "zzz", "dogs et le tapiss", "cat chat", "éé the"):
        got, want = model.predict(text), brute(rows, prior, text)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1])


def test_defined_cases(spark):
    docs = spark.createDataFrame(TRAIN, SCHEMA)
    model = L.train(docs)
    rows = [(1, None, None, 1, "x"), (2, "", None, 1, "x"), (3, "12 34 _ !", None, 1, "x"), (4, "the cat", "en", 1, "x"), (4, "the cat", "en", 1, "x"), (None, "le chien " * 100_000, None, None, None), (5, "語", None, 1, "x")]
    out = L.identified(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text"), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in out] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "fr"), (5, "en")]
    assert all(0 <= r.score <= 1 for r in out) and out[0].score == 0 and out[5].score == 1
    kept = L.keep_identified(spark.createDataFrame(rows, SCHEMA), model)
    assert kept.schema == docs.schema and kept.count() == 4 and "x" in {r.score for r in kept.collect()}
    none = L.train(docs.limit(0))
    assert {tuple(r) for r in L.identified(docs.select("text"), none).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert L.identified(docs.limit(0), model, lang="l", score="s").collect() == []


def test_held_out_accuracy(spark):
    out = L.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    rows = out.filter("held_out and lang is not null").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows) and len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert out.filter((F.col("lang_pred") == "und") & F.col("text").rlike("[a-z]")).count() == 0


def test_every_language_is_learnt_and_rare_ones_keep_their_entries(spark):
    rng = __import__("random").Random(3)
    known = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(12)] for k in range(260)}
    rows = [(0, " ".join(rng.choice(v) for _ in range(90)), k) for k, v in known.items()] + [(1, " ".join(rng.choice(known["l000"]) for _ in range(900)), "l000")] * 30
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), entries=40)
    assert len(model.languages) == 260
    assert sum(model.predict(" ".join(v[:6]))[0] == k for k, v in known.items()) > 250


def test_frequencies_are_of_all_that_was_counted(spark):
    rows = [(1, "common " * 8 + "other " * 4 + "third " * 4, "aa"), (2, "common " * 4 + "strange " * 12, "bb")]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), entries=1)
    assert set(model.rows[0]) | set().union(*model.rows[1:]) and model.rows[0].keys() <= {"common", "strange"}
    if "common" in model.rows[0]:
        k = model.rows[0]["common"]
        got = {model.languages[x]: a for x, a in zip(model.language[model.begin[k] : model.begin[k + 1]], model.above[model.begin[k] : model.begin[k + 1]])}
        assert got == pytest.approx({"aa": 7 + math.log10(8 / 16), "bb": 7 + math.log10(4 / 16)})


def test_ties_go_to_the_first_language_and_names_may_clash(spark):
    rows = [(1, "same words here", "zz"), (2, "same words here", "aa")] * 4
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), min_count=1)
    assert model.predict("same words")[0] == "aa" and model.predict("unlike")[0] == "aa"
    docs = spark.createDataFrame([(1, "same words", 0.5)], "doc_id long, text string, Score double")
    assert L.identified(docs, model).columns == ["doc_id", "text", "Score", "lang_pred", "score_"]


def test_query_is_brute_force(spark):
    """The whole query against counts, cut and sums made here one by one; every labelled row is in the sample at this size."""
    sf, counts, prior = "/root/testdata/sf0.001", {}, {}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    word = __import__("re").compile(r"[^\W\d_]+")
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in docs}
    for d, r in docs.items():
        if held[d] or r.lang is None or r.text is None:
            continue
        prior[r.lang] = prior.get(r.lang, 0) + 1
        for w in word.findall(r.text.lower()):
            p = f" {w} "
            for e in ["0" + w, *("1" + c for c in w), *(f"{n}{p[i : i + n]}" for n in range(2, 7) for i in range(len(p) - n + 1))]:
                counts[r.lang, e] = counts.get((r.lang, e), 0) + 1
    totals, langs = {}, sorted(prior)
    for (lang, e), n in counts.items():
        totals[lang, e[0]] = totals.get((lang, e[0]), 0) + n
    kept = {k: n for k, n in counts.items() if n >= 3}
    top = {e for lang in langs for _, e in sorted((-n, e) for (x, e), n in kept.items() if x == lang)[: L.ENTRIES]}
    log = {(lang, e): max(-7.0, math.log10(n / totals[lang, e[0]])) for (lang, e), n in kept.items() if e in top}
    known = {e for _, e in log}
    for r in L.query(spark, sf).collect():
        own = word.findall((docs[r.doc_id].text or "").lower())
        assert r.held_out == held[r.doc_id]
        if not any(c.isalpha() for w in own for c in w):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        score = {x: math.log10(prior[x] / sum(prior.values())) for x in langs}
        for w in own:
            p, found = f" {w} ", ["0" + w] if "0" + w in known else []
            for n in range(6, 0, -1):
                if not found:
                    q = p if n > 1 else w
                    found = [e for i in range(len(q) - n + 1) if (e := f"{n}{q[i : i + n]}") in known]
            for x in langs:
                score[x] += sum(log.get((x, e), -7.0) for e in found) / max(1, len(found))
        best = max(langs, key=lambda x: (score[x], -langs.index(x)))
        chance = 1 / sum(10 ** max(-300, score[x] - score[best]) for x in langs)
        assert r.score == pytest.approx(chance, rel=1e-6) and (r.lang_pred == best or chance < 0.51), r.doc_id
