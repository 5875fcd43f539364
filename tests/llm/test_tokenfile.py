import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from readloom.llm import tokenfile as T

SCHEMA = "doc_id long, text string, START int, h string"
ROWS = [(i * 7 % 40, f"text {i} " * (i % 5), 1, "x") for i in range(40)] + [(None, "no id", None, None), (None, None, 1, "x"), (50, "", 1, "x"), (51, None, 1, "x"), (52, "same", 1, "x"), (52, "same", 1, "x"), (-9, "long text, " * 60_000, 1, "x"), (53, "é 語 <|endoftext|> ok", 1, "x")]


@pytest.fixture(scope="module")
def made():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def brute(rows, made):
    tokenizer, start, out = Tokenizer.from_str(made), 0, []
    for d, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_cut_encoding_is_whole_encoding(made):
    rng, tokenizer, own = random.Random(3), Tokenizer.from_str(made), T.Encoder(made, remember=500)
    parts = [" ", " ", "  ", "\n", "\n ", "\t", "a", "word", "'s", "It's", "12", ".", "?!", "é", "語", " ", " ", "\x1c", "\x85", "😀", "<|endoftext|>", "don't", "x" * 70, ", ", ". ", ".\n", "_", "\x01", "\x00", "ß", "²", "'", "\xa0", "ǅ", "Б", "e\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    for k in range(0, len(texts), 500):
        some = texts[k : k + 500]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in own.encode(some)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_files_are_brute_force(spark, made):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    folder, manifest = T.write(docs, made)
    got = [tuple(r) for r in T.read(spark, folder, manifest).collect()]
    want = brute(ROWS, made)
    by_start = lambda rows: sorted(rows, key=lambda r: r[1])
    assert sorted(map(str, ((r[0], r[2], r[3]) for r in got))) == sorted(map(str, ((r[0], r[2], r[3]) for r in want)))
    assert [r[0] for r in by_start(got)] == [r[0] for r in want] and [r[1] for r in by_start(got)] == [sum(x[2] for x in by_start(got)[:k]) for k in range(len(got))]
    folder, manifest = T.write(docs.limit(0), made)
    assert manifest == [] and T.read(spark, folder, manifest).collect() == []


def test_shard_format():
    samples = [np.arange(k % 50, dtype="<u2").tobytes() * 3 for k in range(300)]
    for dictionary in (T.make_dictionary(samples), T.make_dictionary([]), T.make_dictionary([b"ab"])):
        sink = io.BytesIO()
        w = T.ShardWriter(sink, dictionary, 2)
        docs = [(3, np.array([5, 6, 7], dtype="<u4")), (None, np.array([2], dtype="<u4")), (9, np.arange(20_000, dtype="<u4")), (9, np.empty(0, dtype="<u4"))]
        for d, ids in docs:
            w.add(d, ids.tobytes())
        w.close()
        data = sink.getvalue()
        r = T.ShardReader(io.BytesIO(data), len(data), dictionary)
        assert [r.document(k).tolist() for k in (2, 0, 3, 1)] == [docs[k][1].tolist() for k in (2, 0, 3, 1)] and r.ids == 20_004
        assert r.index["null"].tolist() == [0, 1, 0, 0]
        with pytest.raises(ValueError, match="dictionary"):
            T.ShardReader(io.BytesIO(data), len(data), dictionary + b"x")
        with pytest.raises(ValueError, match="shard"):
            T.ShardReader(io.BytesIO(data[:-5]), len(data) - 5, dictionary)


def test_query_is_brute_force(spark, made):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, T.query(spark, sf).collect())) == brute(docs, made)
