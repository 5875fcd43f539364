"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over the documents.

A word is a run of ASCII digits, letters (A-Z in lower case) and non-ASCII characters. A window is ``n`` consecutive
words of an item; an item of fewer words, but not none, is one window. A document word inside an occurrence of any
window is hit. Occurrences are found by a rolling hash over vocabulary numbers and then compared number by number,
so a hash collision never makes a hit.

Scale: documents are scanned in place (no shuffle). The benchmark reaches the workers in blocks of at most
``block_words`` words. A benchmark beyond one block is applied block by block over the whole documents: of each block
only what it hits is written to the shared folder, one row a text by the text's MD5, and brought back to the documents
by one join at the end. So neither the broadcast nor a worker grows with the benchmark, and no copy of the documents is made.

Defined cases: a null or wordless text has no words and no hits. A null or wordless item has no windows. An item
with a null id marks words as hit but is in no list of items; rows with equal item ids are one item. Repeated
documents are judged one by one. Empty tables give empty (or all-clean) results. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import WORD_BYTES, fresh, id_text, map_slices, materialise, table
from readloom.operators.joins import apart

WINDOW = 10
#: Words of the benchmark that one broadcast holds, about 300 bytes each in a worker.
BLOCK_WORDS = 200_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_STATE = "struct<hits:array<struct<start:int,end:int>>,items:array<string>,n_words:bigint>"
_FOUND = "key string, hits array<struct<start:int,end:int>>, items array<string>"
_FOUND_ARROW = pa.schema([("key", pa.string()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(WORD_BYTES).split() if text else []


class Windows:
    """The windows of one block of items, ready to be looked up."""

    def __init__(self, n: int = WINDOW):
        self.n, self.size, self.vocabulary, self.found, self.items = n, 0, {}, {}, []
        self.seen: dict[str, int] = {}

    def add(self, item: str | None, item_words: list[bytes]) -> None:
        if not item_words:
            return
        at = -1
        if item is not None:
            at = self.seen.setdefault(item, len(self.items))
            if at == len(self.items):
                self.items.append(item)
        numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item_words]
        k = min(self.n, len(numbers))
        for i in range(len(numbers) - k + 1):
            self.found.setdefault(tuple(numbers[i : i + k]), set()).add(at)
        self.size += len(item_words)

    def freeze(self) -> Windows:
        self.factors = np.random.default_rng(7).integers(1, 1 << 63, self.n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.filters = {}
        for k in sorted({len(w) for w in self.found}):
            h = self.hashes(np.array([w for w in self.found if len(w) == k], dtype=np.uint64).T)
            bits = np.zeros(1 << 22, dtype=bool)
            bits[h >> np.uint64(42)] = True
            self.filters[k] = bits
        return self

    def hashes(self, columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), dtype=np.uint64)
        for factor, column in zip(self.factors, columns):
            out += column * factor
        return out

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its number of words, the hit stretches in word numbers, the items found."""
        counts, every = [], []
        for text in texts:
            own = words(text)
            counts.append(len(own))
            every += own
        out = [(k, [], set()) for k in counts]
        if not every or not self.found:
            return out
        get = self.vocabulary.get
        numbers = np.fromiter((get(w, 0) for w in every), dtype=np.uint64, count=len(every))
        ends = np.cumsum(counts)
        hits: dict[int, list[tuple[int, int]]] = {}
        for k, bits in self.filters.items():
            if len(numbers) < k:
                continue
            last = len(numbers) - k + 1
            h = self.hashes([numbers[j : j + last] for j in range(k)])
            at = np.flatnonzero(bits[h >> np.uint64(42)])
            at = at[(numbers[at] > 0) & (numbers[at + k - 1] > 0)]
            owner = np.searchsorted(ends, at, side="right")
            inside = at + k <= ends[owner]
            for i, d in zip(at[inside].tolist(), owner[inside].tolist()):
                found = self.found.get(tuple(numbers[i : i + k].tolist()))
                if found:
                    start = i - (int(ends[d]) - counts[d])
                    hits.setdefault(d, []).append((start, start + k))
                    out[d][2].update(self.items[x] for x in found if x >= 0)
        for d, found in hits.items():
            out[d][1].extend(merged(found))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def characters(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words as stretches of characters."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in hits]


def without(text: str, hits: list[tuple[int, int]]) -> str:
    out, done = [], 0
    for a, b in characters(text, hits):
        out.append(text[done:a])
        done = b
    return "".join([*out, text[done:]])


def blocks(benchmark: DataFrame, n: int, block_words: int) -> Iterator[Windows]:
    """The benchmark's rows, streamed a partition at a time into blocks; a longer item goes on in the next block."""
    block = Windows(n)
    for item, text in benchmark.toLocalIterator():
        own = words(text)
        at = 0
        while at < len(own):
            room = max(block_words - block.size, 2 * n)
            part = own[at : at + room]
            rest = len(own) - at - len(part)
            block.add(item, part)
            at += len(part) if not rest else len(part) - n + 1
            if block.size >= block_words:
                yield block.freeze()
                block = Windows(n)
    yield block.freeze()


def scanned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, str]:
    """docs with one more struct column, whose name is also returned: hits (word stretches), items, n_words."""
    spark, state = docs.sparkSession, fresh(docs, "decontamination")
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text].cast("string").alias("text"))
    every = blocks(items, n, block_words)
    first, second = next(every), next(every, None)
    if second is None:
        out = docs.withColumn(state, F.lit(None).cast(_STATE))
        return map_slices(out, _step(spark.sparkContext.broadcast(first), text_col, state), out.schema, text_col), state
    texts, found = docs.select(F.md5(docs[text_col].cast("string").cast("binary")).alias("key"), docs[text_col].cast("string").alias("text")), None
    for block in chain((first, second), every):
        shared = spark.sparkContext.broadcast(block)
        # Copies of one text meet in their tasks first.
        own = materialise(map_slices(texts, _found(shared), _FOUND).dropDuplicates(["key"]), "decontaminate")
        shared.unpersist()
        found = own if found is None else found.unionByName(own)
    key, hits = fresh(docs, "decontamination_key"), fresh(docs, "decontamination_hits")
    # A text has a row for each block at most. This side is shuffled for the join, so that a text with very many copies is dealt to several tasks.
    whole = found.groupBy(F.col("key").alias(key)).agg(F.struct(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).alias(hits))
    out = docs.withColumn(key, F.md5(docs[text_col].cast("string").cast("binary"))).join(apart(whole, key), key, "left")
    out = out.select(*[out[f"`{c}`"] for c in docs.columns], F.when(F.col(hits).isNotNull(), F.struct(F.col(hits)["hits"].alias("hits"), F.col(hits)["items"].alias("items"), F.lit(0).cast("long").alias("n_words"))).cast(_STATE).alias(state))
    return map_slices(out, _step(None, text_col, state), out.schema, text_col), state


def _found(block):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [{"key": key, "hits": [{"start": a, "end": b} for a, b in hits], "items": sorted(items)} for key, (_, hits, items) in zip(batch.column(0).to_pylist(), block.value.scan(batch.column(1).to_pylist())) if hits]
        return pa.RecordBatch.from_pylist(rows, _FOUND_ARROW)

    return step


def _step(block, text_col: str, state: str):
    """Fills in the state: from one block, or from what is there already."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, own = batch.schema.get_field_index(text_col), batch.schema.get_field_index(state)
        texts = batch.column(at).to_pylist()
        if block is None:
            found = [(len(words(t)), merged([(x["start"], x["end"]) for x in was["hits"]]) if was else [], was["items"] if was else []) for t, was in zip(texts, batch.column(own).to_pylist())]
        else:
            found = block.value.scan(texts)
        rows = [{"hits": [{"start": a, "end": b} for a, b in hits], "items": sorted(items), "n_words": count} for count, hits, items in found]
        return batch.set_column(own, batch.schema.field(own), pa.array(rows, batch.schema.field(own).type))

    return step


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings) and hits (word stretches) of every document."""
    out, state = scanned(id_text(docs, id_col, text_col), benchmark, **options)
    s = F.col(state)
    return out.select(
        "doc_id",
        s["n_words"].alias("n_words"),
        F.aggregate(s["hits"], F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"])).alias("n_hit"),
        s["items"].alias("item_ids"),
        s["hits"].alias("hits"),
    )


def drop_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without those that have a hit; all columns as they came."""
    out, state = scanned(docs, benchmark, text_col, **options)
    return out.filter(F.size(F.col(state)["hits"]) == 0).select(*[out[f"`{c}`"] for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with hit words cut out of the text; all columns as they came, but for the text."""
    out, state = scanned(docs, benchmark, text_col, **options)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        hits = batch.column(batch.schema.get_field_index(state)).to_pylist()
        cleaned = [without(t, [(x["start"], x["end"]) for x in s["hits"]]) if t and s["hits"] else t for t, s in zip(batch.column(at).to_pylist(), hits)]
        return batch.set_column(at, batch.schema.field(at), pa.array(cleaned, batch.schema.field(at).type))

    return map_slices(out, cut, out.schema, text_col).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH iw AS (SELECT item_id, {_SQL_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
iv AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
  SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
  FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS k FROM iw WHERE len(w) > 0))),
dw AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
dv AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
  SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
  FROM dw, (SELECT DISTINCT k FROM iv) WHERE len(w) >= k)),
hit AS (SELECT dv.r, dv.i, dv.k, iv.item_id FROM dv JOIN iv ON dv.k = iv.k AND dv.win = iv.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
