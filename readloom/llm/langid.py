"""Language identification by word-first backoff.

A word known from training adds the log10 of its relative frequency in each language. A word that isn't known is cut
into character n-grams with blanks at its ends: the longest n, from ``ORDER`` down to 1, of which any n-gram is known
decides, and the mean over its known n-grams stands for the word. Where a language lacks an entry that another has,
``PENALTY`` is added. The score is the posterior probability of the best language, with the languages' shares of the
training rows as prior; ties go to the first language in sorted order.

Training reads a sample of labelled rows, drawn by a hash of id and text: about ``per_language`` rows for each
language, however many languages there are. Counts are gathered by partial aggregation. Relative frequencies are of all
words and n-grams of the sample; the model holds, of each language, its own ``entries`` most frequent ones that occur
``min_count`` times, so a small language has as much room as a large one, and keeps an entry's counts in every language.
An entry is stored with the languages that have it, so the model grows with what the languages know, not with the
product of languages and entries. Prediction is a map over whole texts: no shuffle, no group.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if no row is labelled.
A text with letters of which nothing is known gets the most frequent language at its prior. Rows with null lang or
text aren't learned from. Repeated rows are predicted one by one. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import fold, fresh, map_slices, materialise, table

ORDER, PENALTY = 6, 7.0
PER_LANGUAGE, ENTRIES, MIN_COUNT = 2_000, 50_000, 3
UNKNOWN = "und"
#: Words that a worker remembers, in each of two generations.
REMEMBER = 150_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> Counter:
    """Words in lower case with their counts; only those with a letter."""
    return Counter(w for w in _WORD.findall(text.lower()))


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [f"{n}{padded[i : i + n]}" for i in range(len(padded) - n + 1)]


class Model:
    """Entries: '0word' and 'ngram' with n in front, each with the languages that have it and its log10 relative frequency there, over ``-PENALTY``."""

    def __init__(self, counts: list[tuple[str, str, int]], prior: dict[str, int], totals: dict[tuple[str, str], int] | None = None):
        """totals: of a language and the first character of its entries, all that was counted; by default the sum of ``counts``."""
        self.languages = sorted(prior)
        at = {x: i for i, x in enumerate(self.languages)}
        everything = max(1, sum(prior.values()))
        self.prior = np.array([math.log10(prior[x] / everything) for x in self.languages])
        if totals is None:
            totals = Counter()
            for language, entry, n in counts:
                totals[language, entry[0]] += n
        #: Places by entry: words at 0, n-grams at n.
        self.rows: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
        size, rows = 0, np.empty(len(counts), dtype=np.int64)
        for i, (_, entry, _) in enumerate(counts):
            rows[i] = self.rows[int(entry[0])].setdefault(entry[1:], size)
            size += rows[i] == size
        order = np.argsort(rows, kind="stable")
        self.begin = np.searchsorted(rows[order], np.arange(size + 1))
        self.language = np.array([at[x] for x, _, _ in counts], dtype=np.int32)[order]
        self.above = np.array([max(0.0, PENALTY + math.log10(n / totals[x, entry[0]])) for x, entry, n in counts], dtype=np.float64)[order]
        self.young, self.old = {}, {}

    def __getstate__(self):
        return self.__dict__ | {"young": {}, "old": {}}

    def entries(self, word: str) -> tuple[int, ...]:
        """Rows whose mean stands for a word: its own, or those of its known n-grams of the longest n that has any."""
        own = self.rows[0].get(word)
        if own is not None:
            return (own,)
        padded = f" {word} "
        for n in range(min(ORDER, len(padded)), 0, -1):
            get = self.rows[n].get
            known = [r for i in range(len(padded) - n + 1) if (r := get(padded[i : i + n])) is not None]
            if known:
                return tuple(known)
        return ()

    def remembered(self, word: str) -> tuple[int, ...]:
        """In two generations: the older one goes when the younger is full, so what is asked for often stays."""
        found = self.old.get(word)
        if found is None:
            found = self.entries(word)
        if len(word) < 64:
            if len(self.young) >= REMEMBER:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        counted = words(text)
        if not any(c.isalpha() for w in counted for c in w):
            return UNKNOWN, 0.0
        rows, weights = [], []
        for (w, n), found in zip(counted.items(), list(map(self.young.get, counted))):
            if found is None:
                found = self.remembered(w)
            if len(found) == 1:
                rows.append(found[0])
                weights.append(n)
            elif found:
                rows += found
                weights += [n / len(found)] * len(found)
        score = self.prior
        if rows:
            # Every entry costs the penalty in all languages, less what it is above that in those that have it.
            weight, row = np.array(weights, dtype=float), np.array(rows)
            first, size = self.begin[row], self.begin[row + 1] - self.begin[row]
            ends = np.cumsum(size)
            at = np.repeat(first - ends + size, size) + np.arange(ends[-1])
            score = score + np.bincount(self.language[at], np.repeat(weight, size) * self.above[at], len(score)) - PENALTY * weight.sum()
        best = int(np.argmax(score))
        return self.languages[best], float(1 / (10.0 ** np.clip(score - score[best], -300, 0)).sum())


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, entries: int = ENTRIES, min_count: int = MIN_COUNT) -> Model:
    rows = labelled.select(labelled[id_col].alias("doc_id"), labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).filter("lang is not null and text is not null")
    prior = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not prior:
        return Model([], {})
    share = F.create_map(*[F.lit(x) for k, n in prior.items() for x in (k, min(1.0, per_language / n))])
    drawn = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 53) - 1)) < F.try_element_at(share, F.col("lang")) * float(1 << 53)
    sample = rows.filter(drawn).select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: Counter = Counter()
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            for w, n in words(text).items():
                out[lang, "0" + w] += n
                for k in range(1, ORDER + 1):
                    for g in grams(w, k):
                        out[lang, g] += n
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in out]), pa.array([k[1] for k in out]), pa.array(list(out.values()), pa.int64())], names=["lang", "entry", "n"])

    counts = materialise(map_slices(sample, count, "lang string, entry string, n bigint").groupBy("lang", "entry").agg(F.sum("n").alias("n")), "language-counts")
    kind = F.substring("entry", 1, 1)
    totals = {(r.lang, r.kind): r.n for r in counts.groupBy("lang", kind.alias("kind")).agg(F.sum("n").alias("n")).collect()}
    # The first entries of each language, found in each task before they meet; then their counts in every language.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "entry"))
    own = counts.filter(F.col("n") >= min_count).withColumn("place", place).filter(F.col("place") <= entries).select("entry").distinct()
    kept = counts.filter(F.col("n") >= min_count).join(own, "entry", "left_semi").select("lang", "entry", "n").toArrow().sort_by([("lang", "ascending"), ("entry", "ascending")])
    return Model(list(zip(*(kept.column(x).to_pylist() for x in ("lang", "entry", "n")))), prior, totals)


def identified(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, the language and its score; where a name is taken, _ goes behind."""
    from pyspark.sql import types as T

    lang, score = fresh(docs, lang), fresh(docs, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*batch.schema.names, lang, score])

    return map_slices(docs, step, schema, text_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs whose language is known with a score of ``least``; all columns as they came."""
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    out = identified(docs, model, text_col, lang, score)
    return out.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold("doc_id", 3) != 1))
    out = identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
