import hashlib

import pytest

from readloom.llm import lcp as L

ROWS = [(i * 7 % 101, f"document {i} " + " ".join(f"w{(i * k) % 97}x{k}" for k in range(i % 40)), 1) for i in range(101)]
ROWS += [(None, "no id at all", 1), (None, None, 1), (500, "", 1), (500, "twice", 1), (500, "twice", 1), (-3, "long " * 40_000, 1), (7, "same id as another", 1)]


def brute(rows):
    rows = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        if i + 1 == len(rows):
            nxt = rows[0][1]
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        p, q, r = (L.sketches([x])[0] for x in (t, e, nxt))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, L.likeness(p, q), L.likeness(p, r)))
    return out


@pytest.mark.parametrize("parts,limit", [(1, 1 << 20), (7, 300)])
def test_order_and_prints_are_brute_force(spark, parts, limit):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, key int")
    got = [tuple(r) for r in L.fingerprints(docs, parts=parts, limit=limit).collect()]
    assert sorted(got, key=str) == sorted(brute(ROWS), key=str)


def test_one_and_none(spark):
    docs = spark.createDataFrame([(1, "alone here", 1)], "doc_id long, text string, part int")
    assert [tuple(r) for r in L.fingerprints(docs).collect()] == brute([(1, "alone here", 1)])
    assert L.fingerprints(docs.limit(0)).collect() == []


def test_edit_keeps_likeness():
    a, b = (" ".join(f"{s}{i * i % 977}" for i in range(600)) for s in ("left", "rite"))
    p, q, r = L.sketches([a, L.edited(a, b), b])
    assert 0.35 < L.likeness(p, q) < 0.7 and L.likeness(p, r) < 0.1
    x, y, z = L.sketches(["zzz " + a, a, "shifted by a few words " + a])  # offsets don't matter
    assert L.likeness(x, y) > 0.9 and L.likeness(y, z) > 0.9


def test_prints_of_equal_texts_are_equal_in_any_batch():
    texts = ["", "a", "aa", "ab", "aaaa", "x" * 1000, "é" * 7, "ab" * 500, "the end"] + [t or "" for _, t, _ in ROWS]
    assert L.sketches(texts) == [L.sketches([t])[0] for t in texts] == L.sketches(texts[::-1])[::-1]
    assert L.likeness(*L.sketches(["", ""])) == 1.0 and L.likeness(*L.sketches(["", "a"])) == 0.0


def test_one_id_and_null_ids_with_many_rows_are_cut_up(spark):
    rows = [(None, f"text {i * 37 % 300:03d} of nobody", 1) for i in range(300)] + [(5, f"{i * 11 % 300:03d} of five " * (i % 5 + 1), 1) for i in range(300)] + [(None, None, 1)] * 50 + [(5, "same", 1)] * 50 + [(-(1 << 63), "least", 1), ((1 << 63) - 1, "most", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = [tuple(r) for r in L.fingerprints(docs, parts=16).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    sizes = [r["count"] for r in L.ranged(docs.selectExpr("doc_id", "coalesce(text, '') AS text"), 16).filter("not tail").groupBy("part").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) > 8 and max(sizes) < len(rows) / 4


def plain_names(text, levels=L.LEVELS):
    """The parse of one text, symbol by symbol, with whole phrases for names: (level, phrase) for each phrase."""
    symbols, out = list(text.encode()), []

    def number(x):
        return x if isinstance(x, int) else hashed[x]

    def coin(a, b):
        low = ((a ^ b) & -(a ^ b)).bit_length() - 1 if a != b else 0
        return 2 * low + (b >> low & 1)

    def mix(x):
        m = (1 << 64) - 1
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ x >> 31

    hashed, m = {}, (1 << 64) - 1
    for level in range(1, levels):
        # Runs become one symbol.
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        symbols = [s if n == 1 else mix((s * 0x9E3779B97F4A7C15 + n) & m) for s, n in runs]
        n = len(symbols)
        if not n or n == 1 and level > L.LOW:
            return out
        first = [0] + [coin(a, b) for a, b in zip(symbols, symbols[1:])]
        label = [0] + [coin(a, b) for a, b in zip(first, first[1:])]
        start = [k for k in range(n) if k == 0 or 1 < k < n - 1 and label[k - 1] < label[k] >= label[k + 1]]
        phrases = [symbols[a:b] for a, b in zip(start, [*start[1:], n])]
        symbols = [mix((sum((s + 1) * pow(0x9E3779B97F4A7C15, k % 64 + 1, 1 << 64) for k, s in enumerate(p)) + len(p) * (2 * level + 1)) & m) for p in phrases]
        out.append((level, phrases, symbols))
    return out


def test_parse_is_a_plain_one():
    rng = __import__("random").Random(4)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 300))) for _ in range(60)] + ["a", "aaaa", "abab" * 50, "the quick brown fox jumps over the lazy dog " * 5]
    for t in texts:
        got = [(level, names.tolist()) for names, _, level in L.names([t.encode()])]
        assert got == [(level, names) for level, _, names in plain_names(t)], t
    # Phrases cover the text, and equal names stand for equal phrases.
    for _, phrases, names in plain_names(texts[-1]):
        assert len(set(map(tuple, phrases))) == len(set(names))


def test_sketch_estimates_the_shared_names():
    rng = __import__("random").Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    for share in (0.2, 0.5, 0.8):
        a = [word() for _ in range(800)]
        b = a[: int(800 * share)] + [word() for _ in range(800 - int(800 * share))]
        one, two = (" ".join(x) for x in (a, b))
        sets = [{n for level, _, names in plain_names(t) if level >= L.LOW for n in names} for t in (one, two)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert abs(L.likeness(*L.sketches([one, two])) - true) < 0.15
