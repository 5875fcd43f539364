"""Toxicity: subword-bag embeddings, averaged over windows, into a linear softmax.

A word (letters, in lower case) is the bag of itself and its character n-grams of 3 to 5 with marks at its ends, hashed
into ``BUCKETS``; its vector is the mean of their embeddings. A window is ``WINDOW`` words in a row, from every word on; its
vector is the mean over its words. A linear layer and a softmax give a window's chance of each class, and a text is as
toxic as its most toxic window: so one insult counts as much in a long text as in a short one. With ``window=None`` the
whole text is one window, the plain average; it finds fewer (figures in the README). Embeddings and layer are trained
together by gradient descent (Adagrad) in numpy on a sample: about ``per_class`` labelled rows of each class, of up to
``LONGEST`` characters, drawn by a hash of id and text; training takes every ``TRAIN_STEP``-th window. It starts with the mean of
all windows and sharpens to the most toxic one. Misspelt words share n-grams with known ones, and so their vectors.

As the layer is linear, a word adds one number to the difference of the two classes; scoring adds these up, a map
over whole texts, however long, with a bounded memory of words and no shuffle. Only training joins the labels to their
texts: the ids drawn, about twice ``per_class``, are sent to the documents, and the words of the sample, bounded in rows and
in characters, reach the driver.

Defined cases: a null text, or one without a word, gets the chance of the bias alone, never above 0.5. Labels that
are null, or whose document is missing, are not learned from; repeated ones are learned from once. With rows of one class or none all scores are 0. Repeated rows are
scored one by one. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import fold, id_text, map_slices, table

BUCKETS, DIMENSION, WINDOW, STEP, TRAIN_STEP = 1 << 18, 4, 6, 1, 3
PER_CLASS, LONGEST, EPOCHS, CUT = 1_500, 50_000, 30, 0.7
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def bag(word: str) -> list[int]:
    """Buckets of a word and its n-grams."""
    padded = f"<{word}>"
    out = {zlib.crc32(padded.encode()) % BUCKETS}
    for n in (3, 4, 5):
        out.update(zlib.crc32(padded[i : i + n].encode()) % BUCKETS for i in range(len(padded) - n + 1))
    return sorted(out)


def windows(n: int, window: int | None = WINDOW, step: int = STEP) -> tuple[np.ndarray, int]:
    """Where the windows of n words start, and how many words each has."""
    if window is None or n <= window:
        return np.zeros(1, dtype=np.int64), n
    at = np.arange(0, n - window + 1, step)
    return (at if at[-1] == n - window else np.append(at, n - window)), window


class Model:
    def __init__(self, weights: np.ndarray | None, bias: float = 0.0, window: int | None = WINDOW):
        self.weights, self.bias, self.window, self.known = weights, bias, window, {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        own = words(text)
        if not own:
            return 1 / (1 + np.exp(-min(self.bias, 0.0)))
        found = list(map(self.known.get, own))
        if None in found:
            for k, w in enumerate(own):
                if found[k] is None:
                    found[k] = float(self.weights[bag(w)].mean())
                    if len(w) <= 64:
                        if len(self.known) >= 500_000:
                            self.known.clear()
                        self.known[w] = found[k]
        size = len(own) if self.window is None else min(len(own), self.window)
        sums = np.concatenate([[0.0], np.cumsum(found)])
        return float(1 / (1 + np.exp(-np.clip((sums[size:] - sums[:-size]).max() / size + self.bias, -500, 500))))


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, … of size[0] numbers, then those from at[1] on."""
    return np.repeat(at - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(groups, column, n) for column in values.T], axis=1).astype(np.float32)


def fit(texts: list[list[str]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.2, window: int | None = WINDOW) -> Model:
    """texts: the words of each, one at least."""
    if len(set(labels.tolist())) < 2:
        return Model(None, window=window)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in t], dtype=np.int64) for t in texts]
    bags = [bag(w) for w in number]
    size = np.array([len(b) for b in bags])
    flat, begin = np.array([b for x in bags for b in x]), np.cumsum(size) - size
    places = [windows(len(d), window, TRAIN_STEP) for d in docs]
    rng = np.random.default_rng(3)
    table = (rng.random((BUCKETS, DIMENSION), dtype=np.float32) - 0.5) / DIMENSION
    layer, bias = (rng.random((DIMENSION, 2), dtype=np.float32) - 0.5), np.zeros(2, dtype=np.float32)
    seen = [np.full(BUCKETS, 1e-8, dtype=np.float32), np.full_like(layer, 1e-8), np.full_like(bias, 1e-8)]
    share = np.array([0.5 / max(1, (labels == k).sum()) for k in (0, 1)], dtype=np.float32)
    for epoch in range(epochs):
        # A quarter of the epochs with the mean of all windows, a quarter ever sharper, then the most toxic one.
        sharp = np.clip(32.0 * (epoch / epochs - 0.25), 0, None) if epoch < epochs / 2 else np.inf
        order = rng.permutation(len(docs))
        for k in range(0, len(order), 64):
            some = order[k : k + 64]
            own = [docs[i] for i in some]
            known, inside = np.unique(np.concatenate(own), return_inverse=True)
            vectors = np.add.reduceat(table[flat[_ranges(begin[known], size[known])]], np.cumsum(size[known]) - size[known], axis=0) / size[known, None]
            counts = np.array([len(places[i][0]) for i in some])
            owner, first = np.repeat(np.arange(len(some)), counts), np.cumsum(counts) - counts
            before = np.cumsum([len(d) for d in own]) - [len(d) for d in own]
            at, length = np.concatenate([places[i][0] + b for i, b in zip(some, before)]), np.repeat([places[i][1] for i in some], counts)
            means = np.add.reduceat(vectors[inside[_ranges(at, length)]], np.cumsum(length) - length, axis=0) / length[:, None]
            z = means @ (layer[:, 1] - layer[:, 0])
            over = z - np.maximum.reduceat(z, first)[owner]
            pull = (over == 0).astype(float) if sharp == np.inf else np.exp(sharp * over)
            pull = (pull / np.add.reduceat(pull, first)[owner]).astype(np.float32)
            hidden = np.add.reduceat(means * pull[:, None], first, axis=0)
            logit = hidden @ layer + bias
            chance = np.exp(logit - logit.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            gap = (chance - np.eye(2, dtype=np.float32)[labels[some]]) * (share[labels[some]] * len(docs) / len(some))[:, None]
            down = gap @ layer.T
            for parameter, g, s in ((layer, hidden.T @ gap, seen[1]), (bias, gap.sum(axis=0), seen[2])):
                s += g * g
                parameter -= rate * g / np.sqrt(s)
            # Back through the windows that count, to their words, to the words' buckets.
            used = np.flatnonzero(pull > 1e-3)
            to_windows = down[owner[used]] * (pull[used] / length[used])[:, None]
            word, back = np.unique(inside[_ranges(at[used], length[used])], return_inverse=True)
            to_words = _sums(np.repeat(to_windows, length[used], axis=0), back, len(word)) / size[known[word], None]
            bucket, back = np.unique(flat[_ranges(begin[known[word]], size[known[word]])], return_inverse=True)
            g = _sums(np.repeat(to_words, size[known[word]], axis=0), back, len(bucket))
            seen[0][bucket] += (g * g).mean(axis=1)
            table[bucket] -= rate * g / np.sqrt(seen[0][bucket])[:, None]
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]), window)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, window: int | None = WINDOW) -> Model:
    """Learns from labelled rows; ``docs`` and ``labels`` hold those only that may be learned from."""
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null").distinct()
    counts = dict(marks.groupBy("y").count().collect())
    if len(counts) < 2:
        return Model(None, window=window)
    share = F.when(F.col("y") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    drawn = marks.filter(F.xxhash64("doc_id", F.lit(17)).bitwiseAND(F.lit((1 << 53) - 1)) < share * float(1 << 53))
    # About per_class ids of each class, each once: small enough to go to the texts, which stay where they are.
    texts = id_text(docs, id_col, text_col).filter(F.length("text") <= LONGEST).join(F.broadcast(drawn), "doc_id").select("doc_id", "y", "text")
    # Where ids repeat, their rows are thinned out by text; equal rows are learned from once.
    thin = min(1.0, 4 * per_class / max(1, texts.count()))
    texts = texts.filter(F.xxhash64("text", F.lit(19)).bitwiseAND(F.lit((1 << 53) - 1)) < thin * float(1 << 53)).distinct()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.set_column(2, batch.schema.field(2), pa.array([" ".join(words(t)) for t in batch.column(2).to_pylist()], pa.string()))

    found = map_slices(texts, step, "doc_id bigint, y int, text string").filter("text <> ''").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending"), ("y", "ascending")])
    return fit([x.split(" ") for x in found.column("text").to_pylist()], np.array(found.column("y").to_pylist(), dtype=int), window=window)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return map_slices(id_text(docs, id_col, text_col), step, "doc_id bigint, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = fold("doc_id", 3) != 1
    out = scored(docs, train(docs.filter(learn), labels.filter(learn)))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
