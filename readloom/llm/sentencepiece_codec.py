"""SentencePiece encoding and decoding of whole texts by streaming Viterbi (see ``pieces``).

A map over whole texts without a shuffle; the vocabulary reaches the workers as a broadcast of its pieces (a fixed
size: the vocabulary's). A worker keeps the window of one text since its last commit, and a bounded memory of stretches.

Defined cases: a null text gives null ids and a null decoded text; an empty one gives no ids and decodes to the empty
text. Any other text decodes to itself. Repeated rows are encoded one by one. Extra columns pass through ``with_ids``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from readloom.llm.common import fresh, id_text, map_slices, table
from readloom.llm.pieces import Vocabulary, decode

#: Bytes of text that are encoded at once, which bounds what a worker needs besides its memory of words.
TEXTS = 2 << 20
#: Words and stretches that a worker remembers where encoding is its only work, as in ``query``.
REMEMBER = 1_800_000


def load(path: str | None = None) -> Vocabulary:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Vocabulary.load(path)


def with_ids(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", name: str = "piece_ids") -> DataFrame:
    """docs with one more column: the ids of the text, array<int>."""
    shared, name = docs.sparkSession.sparkContext.broadcast(vocabulary), fresh(docs, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType(), False))])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        found = [None if t is None else x.astype(np.int32) for t, x in zip(texts, shared.value.encoder().encode_all(texts))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.field("element", pa.int32(), False)))], names=[*batch.schema.names, name])

    return map_slices(docs, step, schema, text_col, TEXTS)


def decoded(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """rows with one more column: the text that the ids spell; null for null ids."""
    shared, name = rows.sparkSession.sparkContext.broadcast(vocabulary), fresh(rows, name)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [None if x is None else decode(shared.value, x) for x in part.column(part.schema.get_field_index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name])

    return rows.mapInArrow(run, schema)


def verified(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, piece_ids and round_trip (the ids decode to the text) of every document, in one pass through one worker."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    element = pa.field("element", pa.int32(), False)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = shared.value.encoder(), batch.column(1).to_pylist()
        ids = [None if t is None else x.astype(np.int32) for t, x in zip(texts, own.encode_all(texts))]
        same = [t is None if x is None else decode(own.v, x.tolist()) == t for t, x in zip(texts, ids)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([0 if x is None else len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(element)), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "piece_ids", "round_trip"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("round_trip", T.BooleanType())])
    return map_slices(id_text(docs, id_col, text_col), step, schema, limit=TEXTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256, round_trip."""
    docs, shared = table(spark, sf_dir, "documents").select("doc_id", "text"), spark.sparkContext.broadcast(load())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = shared.value.encoder(REMEMBER), batch.column(1).to_pylist()
        ids = [None if t is None else x for t, x in zip(texts, own.encode_all(texts))]
        back = [None if x is None else decode(own.v, x.tolist()) for x in ids]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([0 if x is None else len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(b"" if x is None else x.tobytes()) for x in ids], pa.int64()),
                pa.array([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                pa.array([a == b for a, b in zip(texts, back)]),
            ],
            names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"],
        )

    return map_slices(docs, step, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean")
