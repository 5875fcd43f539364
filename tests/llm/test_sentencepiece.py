import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from readloom.llm import pieces as P
from readloom.llm import sentencepiece_codec as C

SCHEMA = "doc_id long, text string, piece_ids string, decoded int"


@pytest.fixture(scope="module")
def vocabulary():
    return C.load()


def toy(scores):
    return P.Vocabulary([(p, s, 10 + i) for i, (p, s) in enumerate(scores.items())], {b: 1000 + b for b in range(256)}, 1300)


def best_score(v, spelled):
    """Plain Viterbi over the whole text: the best log probability."""
    scores, best = {p: s for p, s, _ in v.pieces}, [0.0] + [-math.inf] * len(spelled)
    for j in range(1, len(spelled) + 1):
        for i in range(max(0, j - v.longest), j):
            s = scores.get(spelled[i:j])
            if s is None and j == i + 1:
                s = v.foreign(spelled[i])[1]
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def score_of(v, ids):
    own = {i: s for _, s, i in v.pieces}
    return sum(own.get(i, v.floor) for i in ids)


@pytest.mark.parametrize("window", [1, 8, 256])
def test_stream_is_viterbi(monkeypatch, window):
    monkeypatch.setattr(P, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(300):
        v = toy({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))): -rng.random() * 9 for _ in range(8)})
        text = "".join(rng.choice("ab▁c") for _ in range(rng.randint(0, 80)))
        s, out, at = P.Stream(v), [], 0
        while at < len(text):
            step = rng.randint(1, 9)
            out += s.feed(text[at : at + step])
            at += step
        out += s.finish()
        assert score_of(v, out) == pytest.approx(best_score(v, text))
        whole = P.Stream(v)
        assert score_of(v, whole.feed(text) + whole.finish()) == pytest.approx(score_of(v, out))


@pytest.mark.parametrize("window", [1, 8, 256])
def test_stream_is_merging(monkeypatch, window):
    """For merge ranks: the right path is what merging the whole text gives, equal ranks and odd merges included."""
    monkeypatch.setattr(P, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(300):
        made = {"".join(rng.choice("ab▁") for _ in range(rng.randint(2, 5))): -float(rng.randint(0, 6)) for _ in range(9)}
        v = toy(made | {c: -99.0 for c in "ab▁"})
        v.ranks = made
        text = "".join(rng.choice("ab▁c") for _ in range(rng.randint(0, 80)))
        want = [i for p in v.merged(text) for i in ([10 + [*made, *"ab▁"].index(p)] if p in made or p in "ab▁" else [1000 + b for b in p.encode()])]
        s, out, at = P.Stream(v), [], 0
        while at < len(text):
            step = rng.randint(1, 9)
            out += s.feed(text[at : at + step])
            at += step
        assert out + s.finish() == want and P.Encoder(v).short(text) == want, (made, text)


def test_window_stays_small(vocabulary):
    s = P.Stream(vocabulary)
    for k in range(200):
        s.feed("thequickbrownfox" * 64)
    s.finish()
    assert s.widest < 2 * P.WINDOW + 1024 + vocabulary.longest


TEXTS = ["", " ", "  ", "a", " a", "a ", "Hello  world", "▁", "a▁b", " ▁ ", "퟿語\n\ttab\x00", "x" * 5000, "é" * 300, "a b  c   d ", "<s> </s> <unk> <0x41>", "🎉 ok", "word " * 40_000, "▁▁ ▁"]


def test_round_trip_and_memory(vocabulary):
    rng, own = random.Random(5), P.Encoder(vocabulary, remember=50)
    parts = [" ", "  ", "the", "Thing", "\n", "▁", "é", "12", "語", ".", "zzzzqx"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        ids = own.encode(t)
        assert P.decode(vocabulary, ids) == t
        if len(t) < 3000:
            s = P.Stream(vocabulary)
            assert s.feed(P.written(t)) + s.finish() == ids.tolist()
        if P.BLANK not in t:  # the library makes a blank of it
            assert ids.tolist() == library.encode(t)


def test_frames(spark, vocabulary):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, None, None, None), (3, "a", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = C.with_ids(docs, vocabulary)
    assert out.columns == [*docs.columns, "piece_ids_"]
    back = C.decoded(out, vocabulary, "piece_ids_")
    assert all(r.text == r.decoded_ for r in back.collect()) and back.count() == len(rows)
    assert C.with_ids(docs.limit(0), vocabulary).collect() == []
    both = C.verified(docs, vocabulary)
    assert sorted([(r.doc_id, r.piece_ids) for r in both.collect()], key=str) == sorted([(r.doc_id, r.piece_ids_) for r in out.collect()], key=str)
    assert all(r.round_trip and r.n_tokens == len(r.piece_ids or []) for r in both.collect()) and C.verified(docs.limit(0), vocabulary).collect() == []


def test_query(spark, vocabulary):
    sf = "/root/testdata/sf0.001"
    docs, own = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}, P.Encoder(vocabulary)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = C.query(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        t = docs[r.doc_id]
        ids = np.empty(0, "<u4") if t is None else own.encode(t)
        assert t is None or ids.tolist() == library.encode(t)
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)
        assert r.decoded_sha256 == (None if t is None else hashlib.sha256(t.encode()).hexdigest())


def test_every_stretch_goes_through_the_stream(spark, vocabulary):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ["x" * 5000, "one", "two  blanks "]
    own, fed = P.Encoder(vocabulary), []
    feed = own.stream.feed
    own.stream.feed = lambda text, last=False: fed.append(text) or feed(text, last)
    ids = own.encode_all(texts)
    own.stream.feed = feed
    assert own.stream.commits >= len(fed) - 5 and own.stream.commits > 20
    # Stretches by themselves: words, cut between characters that are side by side in no piece.
    inner = {p[k : k + 2] for p, _, _ in vocabulary.pieces for k in range(len(p) - 1)}
    want = set()
    for t in texts:
        if t and P.BLANK not in t:
            own_text, at = P.written(t), 0
            for k in range(1, len(own_text) + 1):
                if k == len(own_text) or own_text[k - 1 : k + 1] not in inner:
                    want.add(own_text[at:k])
                    at = k
    given = set("".join(fed).split(P.FOREIGN))
    assert len(want) > 1000 and len(want - given) < 0.01 * len(want), sorted(want - given)[:20]
    assert all(a.tolist() == P.Encoder(vocabulary).short(P.written(t)) for t, a in list(zip(texts, ids))[-40:] if t)


def test_what_a_stream_keeps_is_bound_by_the_longest_piece(spark, vocabulary):
    text = max((r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text), key=len)[:20_000]
    s, out = P.Stream(vocabulary), []
    for c in P.written(text):
        out += s.feed(c)
    assert out + s.finish() == P.Encoder(vocabulary).encode(text).tolist()
    assert s.commits > len(text) / 20 and s.widest <= 4 * vocabulary.longest
