"""SimHash near-duplicates by multi-index hashing.

Fingerprint: 64 bits over the XXH64 hashes (seed 42) of all 3-word shingles, repeats included; a bit is 1 if set in
over half of the hashes. Two fingerprints link if they differ in at most two bits.

Links: each distinct fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most two bits,
either their low segments are equal or their high segments differ in one bit at most. So a fingerprint looks up the
Hamming ball of radius 1 around its high segment (33 probes) and its low segment itself (1 probe) in the tables of
segments, and every match is verified over all 64 bits. A segment value held by more than ``BUCKET`` distinct
fingerprints isn't paired; whatever probes it goes the other way: two fingerprints are within two bits exactly if
their 64-bit balls of radius 1 meet, so each emits its 65 ball members, and all that share a member are linked to the
smallest of them. A member is shared by at most 65 fingerprints, so this stays linear and has no hot key.

Components: alternating large-star and small-star rounds over distinct fingerprints, each written to the shared
folder; exact copies meet only in partial aggregates. No link or component passes through the driver.

Defined cases: a null, empty or blank text has no words and fingerprint zero, linked like any other. Rows with a
null doc_id get a component like others; the smallest non-null doc_id names it (null if there is none). Rows of one
doc_id with unlike texts belong to the components of their texts, and ``keep_one`` keeps a row of each component. Repeated
rows are returned as often as they came. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import fresh, id_text, map_slices, materialise, new_path, remove, table
from readloom.operators.joins import apart

SHINGLE, SEED, RADIUS, BUCKET, FREQUENT = 3, 42, 2, 64, 1_000


def fingerprint(text: str | None) -> int:
    w = text.encode("utf-8").lower().split() if text else []
    if not w:
        return 0
    if len(w) <= SHINGLE:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(w, w[1:], w[2:]))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """docs with one more column: the fingerprint as a signed long, under ``name`` or, where that is taken, with _ behind."""
    from pyspark.sql import types as T

    name = fresh(docs, name)

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType(), False)])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([_signed(fingerprint(t)) for t in texts], pa.int64())], names=[*batch.schema.names, name])

    return map_slices(docs, step, schema, text_col)


def _row_per(values: list[int]):
    return F.explode(F.array(*[F.lit(_signed(v)).cast("long") for v in values]))


def links(groups: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``fp``: enough to connect all that are within two bits."""
    low, segment = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)), 1 << 32
    high = F.shiftrightunsigned("fp", 32)
    entries = groups.select("fp", F.explode(F.array(high, low.bitwiseOR(F.lit(segment)))).alias("k"))
    hot = entries.groupBy("k").count().filter(F.col("count") > bucket).select("k")
    masks = [0] + [1 << i for i in range(32)]
    probes = groups.select("fp", F.explode(F.concat(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: high.bitwiseXOR(m)), F.array(low.bitwiseOR(F.lit(segment))))).alias("k"))
    table_side = entries.join(hot, "k", "left_anti").select("k", F.col("fp").alias("other"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS
    pairs = probes.join(table_side, "k").filter((F.col("fp") != F.col("other")) & near).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    dense = probes.join(hot, "k", "left_semi").select("fp").distinct()
    ball = dense.select("fp", _row_per([0] + [1 << i for i in range(64)]).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("c"))
    met = ball.groupBy("c").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    stars = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(fp, root) for every node of the edges (a, b): root is the smallest node that it reaches."""
    spark, path, before = edges.sparkSession, new_path(edges.sparkSession, name), None
    edges = materialise(edges, name, path)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # The aggregated sides are shuffled for the joins, so that a centre with very many neighbours is dealt to several tasks.
        least = apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        down = apart(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        to = new_path(spark, name)
        edges = materialise(small, name, to)
        remove(spark, path)
        path = to
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("b").alias("fp"), F.col("a").alias("root"))
        before = state


def rooted(groups: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """groups (fp, each once, and other columns) with the smallest fingerprint that each reaches, ``root``."""
    return groups.join(components(links(groups.select("fp"), bucket)), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def classes(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(fp, component_id, n: rows of the fingerprint) for rows (doc_id, fp)."""
    named = materialise(rooted(materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "fingerprints"), bucket), "roots")
    return named.join(apart(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "root"), "root").select("fp", "component_id", "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row for each document: doc_id, fp (signed long), component_id."""
    prints = fingerprints(id_text(docs, id_col, text_col)).select("doc_id", "fp")
    prints = materialise(prints, "document-fingerprints")
    found = materialise(classes(prints, bucket), "classes")
    # Fingerprints that more than a FREQUENT-th of all rows have are fewer than FREQUENT: they go to the rows, which stay where they are.
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.col("n") > total / FREQUENT
    many = F.broadcast(found.filter(frequent).drop("n"))
    out = prints.join(many, "fp").unionByName(prints.join(many.select("fp"), "fp", "left_anti").join(found.filter(~frequent).drop("n"), "fp"))
    return out.select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """docs with one row of each component: that of the smallest id (nulls last), of one id's that of the smallest hash of
    the text, then of the row; of equal rows, one."""
    h, r, i = (fresh(docs, x) for x in ("kept_text", "kept_row", "kept_id"))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    marked = docs.withColumns({i: docs[id_col].cast("long"), h: F.xxhash64(docs[text_col].cast("string")), r: F.xxhash64(*plain)})
    prints = fingerprints(marked.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.col(h).alias("h"), F.col(r).alias("r"))).select("doc_id", "h", "r", "fp")
    prints = materialise(prints, "document-fingerprints")
    # One row for each fingerprint before any join: copies meet in partial aggregates only.
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h", "r")
    groups = materialise(prints.groupBy("fp").agg(F.min(own).alias("first")), "fingerprints")
    chosen = materialise(rooted(groups, bucket).groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.h", "first.r"), "kept")
    keys = lambda x: (F.col(i).eqNullSafe(x["doc_id"])) & (F.col(h) == x["h"]) & (F.col(r) == x["r"])
    # Rows that occur more than once are told from the others by counts, so only these have their texts compared again.
    several = prints.groupBy("doc_id", "h", "r").agg(F.count("*").alias("n")).filter("n > 1")
    same = chosen["doc_id"].eqNullSafe(several["doc_id"]) & (chosen["h"] == several["h"]) & (chosen["r"] == several["r"])
    repeated = materialise(chosen.join(several, same, "left_semi"), "repeated")
    if repeated.isEmpty():
        return marked.join(chosen, keys(chosen), "left_semi").drop(i, h, r)
    apart = chosen["doc_id"].eqNullSafe(repeated["doc_id"]) & (chosen["h"] == repeated["h"]) & (chosen["r"] == repeated["r"])
    single = chosen.join(repeated, apart, "left_anti")
    key = fresh(docs, "kept_key")
    # By a key of its own, so that rows are put together within their tasks before they are shuffled.
    copies = marked.join(repeated, keys(repeated), "left_semi").withColumn(key, F.concat_ws(".", F.col(i).cast("string"), F.col(h).cast("string"), F.col(r).cast("string"))).dropDuplicates([key]).drop(key)
    return marked.join(single, keys(single), "left_semi").unionByName(copies).drop(i, h, r)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
