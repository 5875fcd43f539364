"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed level by level. At each level a run of one repeated symbol becomes one symbol; then
deterministic coin tossing (twice: the lowest bit in which a symbol differs from its left neighbour, with that bit's
value) gives neighbours different labels of a small alphabet, and the local maxima of the labels start the phrases.
A phrase's name is a 64-bit hash of its symbols, so equal phrases have equal names in any text and at any offset,
and equal substrings share all names but those near their ends. The names of phrases of level ``LOW`` and above,
and the whole text's name, are the set that the fingerprint sketches: ``BINS`` one-permutation minima of 16 bits.
The likeness of two fingerprints is their share of equal bins, an estimate of the sets' Jaccard likeness.

The edited text of a document needs the next document in descending order of id, then of text. The order is cut into
ranges at places (id and the text's first ``HEAD`` characters) of a sample, about ``SAMPLED`` for each range, so that ranges are of about equal
size even where one id has very many rows; the first text of a range is also sent to the range before it, whose last
document it follows. So each range knows every neighbour, and one shuffle with a sort inside is all that moves. Only rows of one id with one head stay together.

Defined cases: a null text counts as empty; an empty text's fingerprint is all zeros, like another empty text's (1)
and unlike all others (0). Null ids come last in the order; equal ids follow each other by text. A lone document is
its own next. Repeated rows are fingerprinted one by one. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import id_text, ship, slices, table

BINS, LOW, LEVELS = 128, 2, 40
#: Characters of a text that the order is cut at, rows of the sample for each range, most characters of a range (about).
HEAD, SAMPLED, PART = 64, 40, 1 << 29
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_P, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)

_x = np.arange(256)
_low = np.array([(x & -x).bit_length() - 1 if x else 0 for x in range(256)])
#: Coin tossing for a byte with its left neighbour: index left * 256 + own.
_COIN8 = (2 * _low[_x[:, None] ^ _x[None, :]] + (_x[None, :] >> _low[_x[:, None] ^ _x[None, :]] & 1)).astype(np.uint8).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


def _lowest(x: np.ndarray) -> np.ndarray:
    """Number of the lowest bit of each 64-bit word that isn't 0."""
    return np.log2((x & (~x + np.uint64(1))).astype(np.float64)).astype(np.uint8)


def _starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases start: True at texts' first symbols and at local maxima of the labels. Neighbours differ."""
    n = len(symbols)
    label = np.empty(n, dtype=np.uint8)
    if symbols.dtype == np.uint8:
        label[1:] = _COIN8[(symbols[:-1].astype(np.uint16) << 8) | symbols[1:]]
    else:
        differ = symbols[1:] ^ symbols[:-1]
        differ[differ == 0] = 1
        at = _lowest(differ)
        label[1:] = 2 * at + (symbols[1:] >> at.astype(np.uint64) & np.uint64(1)).astype(np.uint8)
    label[0] = 0
    label[first] = 0
    again = np.empty(n, dtype=np.uint8)
    again[1:] = _COIN8[(label[:-1].astype(np.uint16) << 8) | label[1:]]
    again[0] = 0
    again[first] = 0
    out = np.zeros(n, dtype=bool)
    if n > 2:
        out[1:-1] = (again[1:-1] > again[:-2]) & (again[1:-1] >= again[2:])
    last = np.append(first[1:], n) - 1  # a phrase has two symbols at least, unless the text has one
    out[last] = False
    second = first + 1
    out[second[second < n]] = False
    out[first] = True
    return out


def _runs(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a repeated symbol within a text become one symbol each."""
    same = (symbols[1:] == symbols[:-1]) & (owner[1:] == owner[:-1])
    if not same.any():
        return symbols, owner
    keep = np.concatenate([[True], ~same])
    at = np.flatnonzero(keep)
    length = np.diff(np.append(at, len(symbols))).astype(np.uint64)
    out = symbols[at].astype(np.uint64)
    long = length > 1
    out[long] = _mix(out[long] * np.uint64(_P) + length[long])
    return out, owner[at]


def names(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Level by level: (names of the phrases, number of the text of each, level)."""
    sizes = np.array([len(t) for t in texts])
    symbols = np.frombuffer(b"".join(texts), dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    for level in range(1, LEVELS):
        if not len(symbols):
            return
        symbols, owner = _runs(symbols, owner)
        first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        single = np.append(np.diff(first), len(owner) - first[-1]) == 1
        if single.any() and level > LOW:  # a text of one phrase is done
            done = first[single]
            keep = np.ones(len(owner), dtype=bool)
            keep[done] = False
            symbols, owner = symbols[keep], owner[keep]
            if not len(symbols):
                return
            first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        start = np.flatnonzero(_starts(symbols, first))
        place = np.arange(len(symbols)) - np.repeat(start, np.diff(np.append(start, len(symbols))))
        wide = symbols.astype(np.uint64) + np.uint64(1)
        hashed = np.add.reduceat(wide * _POWERS[place & 63], start)
        length = np.diff(np.append(start, len(symbols))).astype(np.uint64)
        symbols, owner = _mix(hashed + length * np.uint64(level * 2 + 1)), owner[start]
        yield symbols, owner, level


def sketches(texts: list[str]) -> list[str]:
    """A fingerprint for each text: BINS groups of four hexadecimal digits."""
    raw = [t.encode("utf-8") for t in texts]
    low = np.full(len(texts) * BINS, 0xFFFFFFFF, dtype=np.uint32)

    def put(symbols, owner):
        h = _mix(symbols ^ np.uint64(0xA5A5A5A55A5A5A5A))
        at = owner.astype(np.int64) * BINS + (h >> np.uint64(57)).astype(np.int64)
        np.minimum.at(low, at, (h & np.uint64(0xFFFFFFFE)).astype(np.uint32))

    full = [i for i, t in enumerate(raw) if t]
    put(np.array([int.from_bytes(hashlib.blake2b(raw[i], digest_size=8).digest(), "little") for i in full], dtype=np.uint64), np.array(full, dtype=np.int64))
    for symbols, owner, level in names(raw):
        if level >= LOW:
            put(symbols, owner)
    low = low.reshape(len(texts), BINS)
    empty = low == 0xFFFFFFFF
    # An empty bin takes the next filled one's value, changed by the distance (one-permutation hashing with rotation).
    twice = np.concatenate([~empty, ~empty], axis=1)
    where = np.where(twice, np.arange(2 * BINS), 4 * BINS)
    nearest = np.minimum.accumulate(where[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    gap = np.minimum(nearest - np.arange(BINS), 2 * BINS)
    value = np.take_along_axis(low, nearest % BINS, axis=1).astype(np.uint64)
    short = (_mix(value + gap.astype(np.uint64) * np.uint64(_P)) >> np.uint64(48)).astype(">u2")
    short[[not t for t in raw]] = 0
    return [row.tobytes().hex() for row in short]


def likeness(a: str, b: str) -> float:
    x, y = np.frombuffer(bytes.fromhex(a), dtype=np.uint16), np.frombuffer(bytes.fromhex(b), dtype=np.uint16)
    if not x.any() or not y.any():
        return float(x.any() == y.any())
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def ranged(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (part, doc_id, text, tail), partitioned by part and in order inside; ids fall, nulls last. A part's tail is the next part's first text."""
    # Text that sorts as the rows do: the id from the top, then the text's head.
    order = F.when(F.col("doc_id").isNull(), "G").otherwise(F.lpad(F.hex(F.bitwise_not("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    rows = docs.withColumn("o", F.concat(order, F.substring("text", 1, HEAD)))
    first, n, size = rows.agg(F.min("o"), F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = parts or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // PART)
    share = min(1.0, float(SAMPLED) * parts / max(1, n))
    drawn = rows.filter(F.xxhash64("o").bitwiseAND(F.lit((1 << 53) - 1)) < share * float(1 << 53)).groupBy("o").agg((F.sum(F.length("text")) + F.count("*")).alias("size")).collect()
    cuts = _cuts(sorted((r.o, r.size) for r in drawn), parts, first)
    last = len(cuts) - 1
    placed = rows.withColumn("code", _place(cuts)("o"))
    part, opens = F.shiftright("code", 1), F.col("code").bitwiseAND(F.lit(1)) == 1
    body = placed.select(part.alias("part"), "doc_id", "text", F.lit(False).alias("tail"))
    # The rows that open a part are few, or copies of one key of which the least text counts.
    heads = placed.filter(opens).groupBy(part.alias("opened")).agg(F.min("text").alias("text"))
    tails = heads.select(F.when(F.col("opened") > 0, F.col("opened") - 1).otherwise(last).cast("int").alias("part"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("tail"))
    return body.unionByName(tails).repartitionById(last + 1, "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), "text")


def _cuts(sample: list[tuple[str, int]], parts: int, first: str | None) -> list[str]:
    """Where parts of about equal size begin; the first one with the first row."""
    cuts, whole, before = [first or ""], sum(size for _, size in sample), 0
    for o, size in sample:
        if before * parts >= len(cuts) * whole and o > cuts[-1]:
            cuts.append(o)
        before += size
    return cuts


def _place(cuts: list[str]):
    """Twice the number of a row's part, and 1 more if the row may be its first."""
    import pandas as pd

    def place(orders: pd.Series) -> pd.Series:
        at = [bisect.bisect_right(cuts, o) - 1 for o in orders]
        return pd.Series([2 * k + (cuts[k] == o) for k, o in zip(at, orders)], dtype="int32")

    return F.pandas_udf(place, "int", F.PandasUDFType.SCALAR)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, limit: int = 2 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spark = docs.sparkSession
    ship(spark)
    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = ranged(rows, parts).select("part", "doc_id", "text", "tail")

    def finish(held: list, following: str, following_print: str) -> pa.RecordBatch:
        ids, texts = [x[0] for x in held], [x[1] for x in held]
        others = [edited(t, f) for t, f in zip(texts, [*texts[1:], following])]
        every = sketches([*texts, *others, following])
        prints, changed = every[: len(texts)], every[len(texts) : -1]
        nexts = [*prints[1:], every[-1]]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in others]), pa.array(prints), pa.array(changed), pa.array([likeness(a, b) for a, b in zip(prints, changed)]), pa.array([likeness(a, b) for a, b in zip(prints, nexts)])],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part, closed = [], 0, None, False
        for p, doc_id, text, tail in (row for batch in batches for some in slices(batch, "text") for row in zip(*(c.to_pylist() for c in some.columns))):
            if p != part:
                assert not held, "a part has no tail"
                part, closed = p, False
            if tail and closed:
                continue
            if held and (tail or size > limit):
                yield finish(held, text, "")
                held, size = [], 0
            if tail:
                closed = True
                continue
            held.append((doc_id, text))
            size += len(text)
        assert not held, "the last part has no tail"

    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
