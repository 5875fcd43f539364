"""Language-model scores: counts of whole words, and the likelihood of a text over its subword lattice.

Tokens are the words of the text in lower case (A-Z), and one end. ``base_score`` is the smoothed unigram model of
the training tokens. ``score`` is the log10 of the marginal probability of the text: every segmentation of every word
into pieces of an existing vocabulary counts, summed by the forward recursion in log space. The vocabulary's scores
weight the segmentations of the training words; the expected uses of each piece in them, added to ``PRIOR`` pseudo
uses spread by those scores, give the piece probabilities that texts are scored with. The end is a piece of its own.
White space and case A-Z are not scored: the probability is that of the sequence of lower-case words. Of a vocabulary
file of merge ranks the scores are log probabilities by Zipf's law (see ``pieces``).

Scale: words are counted by partial aggregation over all documents, held-out ones with count 0, so the table of words
grows with the corpus and is never gathered in one place. Words that make up a ``1 / HOT``-th of all training tokens
are ``HOT`` at most; they are broadcast and scored where the document is. Only the other words of a document are
shuffled to the table of words, one row for each word of a document, so no key of that join is hot.

Defined cases: a null or empty text has its end only. Rows of equal id and text are scored once and returned as often
as they came. Null ids are scored like others. With no training row every count is 0 and N and V are 0. Empty tables give
empty results. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import fold, id_text, map_slices, materialise, ship, slices, table
from readloom.llm.pieces import BLANK, FOREIGN, Lattice, Vocabulary
from readloom.llm.sentencepiece_codec import load

HOT, FOLDS, PRIOR, HELD = 50_000, 5, 1_000.0, 200_000


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").lower().split() if text else []


def spelled(word: bytes) -> str:
    return BLANK + word.decode("utf-8").replace(BLANK, FOREIGN)


def counted(rows: DataFrame) -> DataFrame:
    """(word, c) of rows (text, learn): how often each word occurs in rows to learn from."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                learnt, other = [], set()
                for text, learn in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    learnt.extend(words(text)) if learn else other.update(words(text))
                held.update(learnt)
                for w in other:
                    held[w] += 0
                if len(held) >= HELD:
                    yield given()
                    held.clear()
        if held:
            yield given()

    return rows.select("text", "learn").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _parts(batch: pa.RecordBatch, most: int = 100_000):
    """Slices of rows (word, ...) with few words and few characters each."""
    for part in slices(batch, "word", 8 * most):
        for k in range(0, part.num_rows, most // 4):
            yield part.slice(k, most // 4)


def learnt_pieces(counts: DataFrame, vocabulary: Vocabulary, ends: int) -> tuple[dict[int, float], float]:
    """Natural log probabilities of the pieces, and of the end, after one pass of expected uses."""
    shared = counts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, expect = Lattice(shared.value), np.zeros(shared.value.size)
        for batch in batches:
            for part in _parts(batch):
                lattice.forward([spelled(w) for w in part.column(0).to_pylist()], expect, part.column(1).to_numpy(zero_copy_only=False).astype(float))
        at = np.flatnonzero(expect)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(expect[at], pa.float64())], names=["piece", "uses"])

    uses = dict(counts.filter("c > 0").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses")).collect())
    prior = {i: math.exp(s) for i, s in vocabulary.log.items()} | {i: 256 / (len(vocabulary.log) + 256) / 256 for i in vocabulary.byte_ids.values()}
    spread = PRIOR / sum(prior.values())
    total = sum(uses.values()) + PRIOR + ends + 1
    return {i: math.log((uses.get(i, 0.0) + spread * p) / total) for i, p in prior.items()}, math.log((ends + 1) / total)


def scored(docs: DataFrame, vocabulary: Vocabulary, learn, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; ``learn`` says, as a condition on doc_id, which rows to learn from."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).withColumn("learn", learn)
    counts = materialise(counted(rows), "words")
    ends = rows.filter("learn").count()
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = seen.n + ends, seen.v + (ends > 0)
    log, end = learnt_pieces(counts, vocabulary, ends)
    model = spark.sparkContext.broadcast((vocabulary, log))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for batch in batches:
            for part in _parts(batch):
                p = lattice.forward([spelled(w) for w in part.column(0).to_pylist()]) / math.log(10)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=["word", "c", "p"])

    lexicon = materialise(counts.mapInArrow(rate, "word binary, c bigint, p double"), "lexicon")
    # Counts of these add up to n at most, so there are ``hot`` of them at most.
    common = {bytes(r.word): (r.c, r.p) for r in lexicon.filter(F.col("c") >= max(2, math.ceil(n / hot))).collect()}
    shared = spark.sparkContext.broadcast(common)
    limit = max(2, math.ceil(n / hot))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document one row for all its common words, and one for each of the others."""
        get, number = shared.value.get, 0
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[], [], [], [], [], [], []]
                for doc_id, h, text in zip(*(c.to_pylist() for c in part.columns)):
                    own = Counter(words(text))
                    tokens = known = 0
                    base = p = 0.0
                    for w, k in own.items():
                        tokens += k
                        found = get(w)
                        if found:
                            known += k
                            base += k * math.log10(found[0] + 0.5)
                            p += k * found[1]
                        else:
                            for column, x in zip(out, (doc_id, h, w, k, 0, 0.0, 0.0)):
                                column.append(x)
                    # No word begins with a blank, so this row meets none in the table; numbered, so that no place of the shuffle gets very many.
                    number += 1
                    for column, x in zip(out, (doc_id, h, b" %d" % number, tokens, known, base, p)):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "h", "word", "k", "known", "base", "p"])

    parts = rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(split, "doc_id bigint, h bigint, word binary, k bigint, known bigint, base double, p double")
    rare = lexicon.filter(F.col("c") < limit).select("word", "c", F.col("p").alias("each"))
    joined = parts.join(rare, "word", "left")
    whole = F.col("c").isNull()
    shares = joined.select(
        "doc_id", "h",
        F.when(whole, 1).otherwise(0).alias("copies"),
        F.when(whole, F.col("k")).otherwise(0).alias("tokens"),
        F.when(whole, F.col("known")).otherwise(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"),
        F.when(whole, F.col("base")).otherwise(F.col("k") * F.log10(F.col("c") + 0.5)).alias("base"),
        F.when(whole, F.col("p")).otherwise(F.col("k") * F.col("each")).alias("p"),
    )
    sums = shares.groupBy("doc_id", "h").agg(*[F.sum(x).alias(x) for x in ("copies", "tokens", "known", "base", "p")])
    per = {x: F.col(x) / F.col("copies") for x in ("tokens", "known", "base", "p")}
    tokens = per["tokens"].cast("long") + 1
    end_c = math.log10(ends + 0.5)
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id",
        tokens.alias("n_tokens"),
        (per["known"].cast("long") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (per["base"] + end_c - tokens * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        (per["p"] + end / math.log(10)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), load(), fold("doc_id", FOLDS) != 1)
    return out.withColumn("held_out", fold("doc_id", FOLDS) == 1)

