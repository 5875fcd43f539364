"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Features are the words (between white space) and pairs of neighbouring words of a text, hashed into ``BUCKETS``. Two
multinomial models, one of the target rows (``labels.quality`` = 1) and one of all rows, each with ``ALPHA`` added to
every bucket, give each text its log importance weight, the sum over its features of log p_target - log p_raw. Adding
standard Gumbel noise and taking the ``fraction`` of largest keys is a draw without replacement in proportion to the
weights. The noise is a function of ``seed``, id and text, so a draw can be repeated and survives a lost executor.

Scale: both models are counted over all rows, as one row of bucket counts for each task, added up by partial
aggregation; a model is ``BUCKETS`` numbers whatever the corpus. The key of the last row taken is found exactly by
counting keys in 2^16 bins, then in bins within the one that holds it, and so on; neither a global sort nor a single task sees all keys.

Defined cases: a null or empty text has no features and weight 0. Rows with the very key of the last row taken are all
taken. Null ids are drawn like others. Without a target row all weights are 0 and the draw is uniform. Empty tables
give empty results. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import id_text, map_slices, materialise, ship, slices, table

BUCKETS, ALPHA, FRACTION, SEED = 1 << 16, 1.0, 0.85, 1


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs, and the number of the text of each."""
    every, sizes = [], []
    for t in texts:
        own = t.encode("utf-8").split() if t else []
        every += own
        sizes.append(len(own))
    h = np.fromiter(map(zlib.crc32, every), dtype=np.uint64, count=len(every))
    owner = np.repeat(np.arange(len(texts)), sizes)
    same = owner[1:] == owner[:-1]
    pairs = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40))[same]
    return np.concatenate([h, pairs]).astype(np.int64) % BUCKETS, np.concatenate([owner, owner[1:][same]])


def counts(rows: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts of rows (text)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(features(part.column(0).to_pylist())[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in rows.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def ratios(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket; docs (doc_id, text), target_ids (doc_id)."""
    raw = counts(docs)
    # As many ids as there are labels: no broadcast, whatever their number.
    target = counts(docs.join(target_ids.hint("merge"), "doc_id", "left_semi"))
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + ALPHA) / (target.sum() + ALPHA * BUCKETS)) - np.log((raw + ALPHA) / (raw.sum() + ALPHA * BUCKETS))


def weighted(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text) and log_weight of every document; docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios(docs, target_ids))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, owner = features(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.bincount(owner, shared.value[at], batch.num_rows), pa.float64())], names=["doc_id", "h", "log_weight"])

    return map_slices(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), step, "doc_id bigint, h bigint, log_weight double")


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column of doubles, exactly, by counts in ever narrower bins."""
    x = F.col(column)
    low, high = keys.agg(F.min(x), F.max(x)).first()
    left = k
    while low < high:
        width = (high - low) / (1 << 16)
        # Where a bin is narrower than the numbers are dense there are fewer numbers than bins: each is its own.
        part = x if width == 0 or low + width == low else F.least(F.floor((x - low) / width), F.lit((1 << 16) - 1))
        found = sorted(keys.filter((x >= low) & (x <= high)).groupBy(part.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("least"), F.max(x).alias("most")).collect(), reverse=True)
        for r in found:
            if left <= r.n:
                break
            left -= r.n
        low, high = r.least, r.most
    return low


def drawn(docs: DataFrame, target_ids: DataFrame, fraction: float = FRACTION, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, key (weight with noise) and selected of every document."""
    rows = weighted(id_text(docs, id_col, text_col), target_ids)
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "h", F.lit(seed)), 11) + F.lit(0.5)) / float(1 << 53)
    rows = materialise(rows.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key")), "weights")
    k = math.ceil(fraction * rows.count())
    least = kth_largest(rows, "key", k) if k else math.inf
    return rows.withColumn("selected", F.col("key") >= least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws the share of the rows that is good among the labelled ones (``FRACTION`` where none is labelled)."""
    labels = table(spark, sf_dir, "labels")
    good = labels.agg(F.avg(F.when(F.col("quality").isNotNull(), (F.col("quality") == 1).cast("double")))).first()[0]
    target = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    return drawn(table(spark, sf_dir, "documents"), target, FRACTION if good is None else good)
