import random

import pytest
import xxhash

from readloom.llm import simhash as S


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(prints):
    """prints: [(doc_id, fp)] to the smallest id reached, row by row."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket", [64, 2])
def test_classes_are_brute_force(spark, bucket):
    rng, prints = random.Random(5), []
    for k in range(30):
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 8])):
            prints.append((len(prints) if len(prints) % 11 else None, fp))
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 2, 3])):
                fp ^= 1 << b
    prints += [(1000 + i, 0xFFFF ^ (1 << i) ^ (1 << (i * 7 % 64))) for i in range(40)]  # many within few bits
    df = spark.createDataFrame([(d, signed(f)) for d, f in prints], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in S.classes(df, bucket).collect()}
    assert [got[signed(f)] for _, f in prints] == brute_classes(prints)


TEXTS = [
    (5, "the quick brown fox jumps over the lazy dog", "x"), (3, "THE quick brown fox\tjumps over the lazy dog", "x"),
    (9, None, None), (8, "", None), (7, " \n ", "x"), (4, "one two", "x"), (6, "one", "x"), (4, "one two", "x"),
    (None, "é è ê ç à", "x"), (None, "é è ê ç à", "x"), (2, "word " * 50_000, "x"), (10, "a b c " * 9, "x"),
]


def test_documents(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, FP string")
    got = S.near_duplicates(docs).collect()
    want = brute_classes([(d, brute_print(t)) for d, t, _ in TEXTS])
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=str) == sorted(((d, signed(brute_print(t)), w) for (d, t, _), w in zip(TEXTS, want)), key=str)
    kept = S.keep_one(docs)
    assert kept.schema.names == docs.schema.names
    assert sorted(((r.doc_id, (r.text or "")[:9]) for r in kept.collect()), key=str) == sorted([(2, "word word"), (3, "THE quick"), (4, "one two"), (6, "one"), (7, " \n "), (10, "a b c a b"), (None, "é è ê ç à")], key=str)
    assert S.near_duplicates(docs.limit(0)).collect() == [] and S.keep_one(docs.limit(0)).collect() == []


def test_one_row_of_each_component_stays_whatever_repeats(spark):
    rng, rows = random.Random(8), []
    texts = [None, "", *(" ".join(rng.choice(["red", "blue", "one", "two", "far", "near"]) for _ in range(rng.randint(1, 12))) for _ in range(25))]
    for _ in range(150):
        rows.append((rng.choice([None, *range(12)]), rng.choice(texts), rng.choice(["a", None])))
    rows += [(5, "alpha beta gamma delta", "x"), (5, "one more unlike text of words", "x"), (7, "a third one that is like none", "x")]
    got = [tuple(r) for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, more string")).collect()]
    of = brute_classes([(k, brute_print(t)) for k, (_, t, _) in enumerate(rows)])
    number = {}
    for k, r in zip(of, rows):
        number.setdefault(brute_print(r[1]), k)
    assert sorted(number[brute_print(t)] for _, t, _ in got) == sorted(set(of)) and set(got) <= set(rows)
    for k in set(of):
        own = [r for r, o in zip(rows, of) if o == k]
        kept = next(r for r in got if number[brute_print(r[1])] == k)
        assert kept[0] == min((r[0] for r in own if r[0] is not None), default=None)


def test_rows_of_one_id_or_text_and_a_clashing_column(spark):
    docs = spark.createDataFrame([(5, "a b c d", 1.0), (5, "w x y z v", 1.0), (7, "k l m n o p", 1.0)] + [(None, None, 2.0)] * 40, "doc_id long, text string, Fp double")
    assert sorted(((r.doc_id, r.text, r.Fp) for r in S.keep_one(docs).collect()), key=str) == sorted([(5, "a b c d", 1.0), (5, "w x y z v", 1.0), (7, "k l m n o p", 1.0), (None, None, 2.0)], key=str)
    assert S.near_duplicates(docs).count() == 43
    assert S.fingerprints(docs).columns == ["doc_id", "text", "Fp", "fp_"]


def test_components_of_stars_chains_and_cycles(spark):
    rng = random.Random(2)
    edges = [(0, k) for k in range(1, 2000)] + [(k, k + 1) for k in range(3000, 3120)] + [(5000, 5001), (5001, 5002), (5000, 5002)] + [(-k, 7000 - k % 3) for k in range(1, 60)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.fp: r.root for r in S.components(df).collect()}
    nodes = {x for e in edges for x in e}
    assert all(got.get(x, x) == find(x) for x in nodes) and set(got) <= nodes
