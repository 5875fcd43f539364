import re

import pytest

from readloom.llm import decontaminate as D

SCHEMA = "doc_id long, text string, N_WORDS int, decontamination string"


def brute(text, items, n=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = low(text), set(), set()
    for item, t in items:
        own = low(t)
        k = min(n, len(own))
        for i in range(len(own) - k + 1) if own else []:
            for j in range(len(w) - k + 1):
                if w[j : j + k] == own[i : i + k]:
                    hit.update(range(j, j + k))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (10, "Éclair au café"), (2, None), (None, "zulu"), (3, "... !!"), (1, "lima mike"), (4, "ten eleven twelve a b c d e f g h")]
DOCS = [
    (1, "x one TWO three, four five six-seven eight nine ten y", 1, "a"),
    (2, "one two three four five six seven eight nine TEN eleven twelve a b c d e f g h i", 1, "a"),
    (2, "one two three four five six seven eight nine TEN eleven twelve a b c d e f g h i", 1, "a"),
    (3, None, 1, None), (4, "", 1, None), (None, "a zulu, lima mike éclair au café Éclair AU café", None, None),
    (5, "w " * 60_000 + "zulu", 1, None), (6, "eclair au cafe", 1, None), (7, "one two three", 1, None),
]


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 21])
def test_report_is_brute_force(spark, block_words):
    docs, items = spark.createDataFrame(DOCS, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.report(docs, items, block_words=block_words).collect()
    want = sorted(((d[0], *brute(d[1], ITEMS)) for d in DOCS), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=str) == want


def test_drop_and_remove(spark):
    docs, items = spark.createDataFrame(DOCS, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.drop_documents(docs, items)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7]
    cut = {r.doc_id: r.text for r in D.remove_spans(docs, items).collect()}
    assert cut[1] == "x  y" and cut[6] == "eclair au cafe" and cut[3] is None
    assert cut[None] == "a  éclair au café "


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in D.report(docs, items).collect()} == {0}
    assert D.report(docs.limit(0), items).collect() == []
    assert D.drop_documents(docs, items).count() == len(DOCS)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_is_its_sql(spark, sf):
    from tests.oracle import compare

    assert compare(D.query(spark, f"/root/testdata/{sf}"), D.SQL, f"/root/testdata/{sf}") > 0


def test_blocks_drop_and_remove_like_one(spark):
    docs, items = spark.createDataFrame(DOCS * 3, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    for function in (D.drop_documents, D.remove_spans):
        one, many = function(docs, items), function(docs, items, block_words=21)
        assert one.schema == many.schema and sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert D.report(docs.limit(0), items, block_words=21).collect() == []
