import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from readloom.llm import secrets as S

SF = "/root/testdata/sf0.01"


def brute_base(text):
    out = []
    for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text or ""):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, (p, least) in enumerate(((r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), kind, m.end()) for m in re.finditer(p, text or "") if len(m[0]) >= least]
    return [(S.KINDS[k], a, b) for a, k, b in sorted(out)]


@pytest.fixture(scope="module")
def model(spark):
    return S.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_base_is_brute_force(model):
    rng, parts = random.Random(1), ["password", "PassWd", "api_key", "ApiKey", "token", "tokenſ", "secret", " ", "  ", "=", ":", '"', "'", "abc", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH", "12345678", "é", "\n", "ﬁ", "K", "x" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", "AKIA" * 6, "0a" * 5000]
    for t in texts:
        base, every = S.scan(t, model)
        assert base == brute_base(t), t
        assert set(base) <= set(every) and every == sorted(every, key=lambda x: (x[1], S.KINDS.index(x[0])))
        added = [x for x in every if x[0] == "crf"]
        assert all(b <= c or d <= a for _, a, b in added for _, c, d in base) and all(t[a:b].strip() for _, a, b in added)


def test_viterbi_is_exhaustive():
    rng = np.random.default_rng(0)
    for _ in range(30):
        m = S.Model(rng.normal(size=(S.BUCKETS, 3)), np.where(np.arange(9).reshape(3, 3) == 7, -1e9, rng.normal(size=(3, 3))))
        rows = rng.integers(0, S.BUCKETS, (rng.integers(1, 6), 4)).tolist()
        score = lambda tags: sum(m.weights[f][t] for r, t in zip(rows, tags) for f in r) + sum(m.moves[a][b] for a, b in zip(tags, tags[1:])) - 1e9 * (tags[0] == S.I)  # noqa: E731, B023
        best = max(itertools.product((0, 1, 2), repeat=len(rows)), key=score)
        assert m.decode(rows) == list(best)


def test_gradient_fits_a_toy():
    rows = [([[1, 5], [2, 5], [3, 5]], [0, 1, 2]), ([[4, 5], [3, 5]], [2, 2])] * 5
    m = S.fit(rows, epochs=80)
    assert all(m.decode(r) == t for r, t in rows)
    assert S.fit([]).decode([[0], [1]]) == [S.O, S.O]


def test_unseen_secrets_are_found(model):
    rng, alnum = random.Random(99), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = wrong = 0
    for _ in range(300):
        key = "ghp_" + "".join(rng.choice(alnum) for _ in range(36)) if rng.random() < 0.5 else "".join(rng.choice(alnum) for _ in range(32)) + "7"
        text = f"The ent of is in. Client key={key} thand there on the."
        at = text.index(key)
        found += any(a <= at and at + len(key) <= b for _, a, b in S.scan(text, model)[1])
        plain = f"Call 555-{rng.randint(1000, 9999)} or write to user{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com on 20{rng.randint(10, 24)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}, from {rng.randint(1, 255)}.{rng.randint(0, 255)}.0.1."
        wrong += bool(S.scan(plain, model)[1])
    assert found >= 285 and wrong <= 6


def test_documents_and_redaction(spark, model):
    schema = "doc_id long, text string, spans int, N_HEX string"
    rows = [(1, 'x password="hunter22" y', 1, "a"), (1, 'x password="hunter22" y', 1, "a"), (2, None, 1, None), (3, "", 1, None), (None, "no digits here", None, None), (4, "word " * 200_000 + "token: " + "q1" * 20, 1, "a"), (5, "é token=abcdef1 AKIA" + "A" * 16, 1, "a")]
    docs = spark.createDataFrame(rows, schema)
    out = {r.doc_id: r.text for r in S.redacted(docs, model).collect()}
    assert S.redacted(docs, model).schema == docs.schema
    assert out[1] == 'x [SECRET]" y' and out[2] is None and out[3] == "" and out[None] == "no digits here" and out[4].endswith("word [SECRET]") and out[5] == "é [SECRET] [SECRET]"
    assert S.redacted(docs.limit(0), S.train(docs.limit(0))).collect() == []


def test_query_is_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = S.query(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        base = brute_base(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in base) for k in S.KINDS[:3]]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_tokens_without_a_digit_short_and_broken_ones_are_found(model):
    rng, letters = random.Random(7), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    pick = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    makes = [lambda: ("Authorization: Bearer ", pick(32)), lambda: ("pwd=", pick(14)), lambda: ("pwd: ", pick(6, letters + "0123456789")), lambda: ("pwd: ", f"{pick(1)}@{pick(2)}!{pick(4)}")]
    for make in makes:
        found = 0
        for _ in range(100):
            lead, value = make()
            text = f"The ent of is in. {lead}{value} thand there on the."
            at = text.index(lead) + len(lead)
            found += any(a <= at and at + len(value) <= b for _, a, b in S.scan(text, model)[1])
        assert found >= 70, lead
    assert S.scan("pwd=QwertyUiopAsdf", model)[1] == [("crf", 4, 18)]


def test_path_over_blocks_is_viterbi():
    rng = np.random.default_rng(3)
    m = S.Model(rng.normal(size=(S.BUCKETS, 3)), np.where(np.arange(9).reshape(3, 3) == 7, -1e9, rng.normal(size=(3, 3))))
    rows = [rng.integers(0, S.BUCKETS, (n, 4)) for n in (1, 2, 31, 32, 33, 200, 1, 64)]
    start = np.concatenate([np.arange(len(r)) == 0 for r in rows])
    got = S.viterbi(m.table[np.concatenate(rows)].sum(axis=1), start, np.array(m.moves)).tolist()
    assert got == [t for r in rows for t in m.decode(r.tolist())]


def test_texts_of_a_batch_do_not_touch_each_other(model):
    texts = ["pwd=", "QwertyUiopAsdf", None, "", "key: ", "x", "pwd: p@ss", "call 555-1234"]
    assert S.scan_all(texts, model) == [S.scan(t, model) for t in texts]


def test_ties_go_the_same_way_in_blocks():
    rng = np.random.default_rng(9)
    for _ in range(20):
        m = S.Model(rng.integers(0, 2, (S.BUCKETS, 3)).astype(float), np.where(np.arange(9).reshape(3, 3) == 7, -1e9, rng.integers(0, 2, (3, 3)).astype(float)))
        rows = [rng.integers(0, S.BUCKETS, (n, 3)) for n in (1, 2, 3, 31, 32, 33, 5)]
        start = np.concatenate([np.arange(len(r)) == 0 for r in rows])
        assert S.viterbi(m.table[np.concatenate(rows)].sum(axis=1), start, np.array(m.moves)).tolist() == [t for r in rows for t in m.decode(r.tolist())]
