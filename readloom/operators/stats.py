"""Run statistics and tag counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from readloom.operators.tags import TAGS


def tag_stats(tagged: DataFrame, order: str | None = "ord", approximate: bool = False) -> DataFrame:
    """One row: reads, tagged reads, reads and distinct values for each tag, single-exon reads, variants, and the first example of each tag.

    True distinct counts take one row for each tag of a read, (number of the tag, value), counted by value and then by tag:
    narrow rows, put together in their tasks first. ``approximate`` makes no rows."""
    own = F.col("tagged")
    names, ordered = [x for x in TAGS if x in tagged.columns], bool(order) and order in tagged.columns
    flags = {"total_reads": F.lit(True), "processed_reads": own, "single_exon_reads": own & (F.size("exons") == 1)}
    counts = {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in flags.items()}
    called = "variant_candidate_count" in tagged.columns
    if called:
        seen, given = F.coalesce("variant_candidate_count", F.lit(0)), F.coalesce("variant_emitted_count", F.lit(0))
        counts |= {"variant_candidates": seen, "variants_emitted": given, "variants_skipped": seen - given, "reads_with_variants": (given > 0).cast("int")}
    if approximate:
        out = [F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in counts.items()]
        for t in names:
            out += [F.count(t).alias(f"tagged_{t}"), F.approx_count_distinct(t).alias(f"unique_{t}")]
            if ordered:
                out.append(F.min_by(t, F.when(F.col(t).isNotNull(), F.col(order))).alias(f"example_{t}"))
        return tagged.agg(*out)
    at = F.col(order) if ordered else F.lit(0)
    # Tag -1 stands for the read itself.
    each = F.array(F.struct(F.lit(-1).alias("k"), F.lit(None).cast("string").alias("v")), *[F.struct(F.lit(i).alias("k"), F.col(t).alias("v")) for i, t in enumerate(names)])
    rows = tagged.select(at.alias("o"), *[v.alias(k) for k, v in counts.items()], F.explode(each).alias("e")).select("o", *counts, "e.k", "e.v").filter((F.col("k") < 0) | F.col("v").isNotNull())
    values = rows.groupBy("k", "v").agg(F.count("*").alias("n"), F.min("o").alias("o"), *[F.sum(F.when(F.col("k") < 0, F.col(c))).alias(c) for c in counts])
    by_tag = values.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("u"), F.min_by("v", "o").alias("x"), *[F.sum(c).alias(c) for c in counts])
    of = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c)))
    out = [F.coalesce(of(-1, c), F.lit(0)).alias(c) for c in counts]
    for i, t in enumerate(names):
        out += [F.coalesce(of(i, "n"), F.lit(0)).alias(f"tagged_{t}"), F.coalesce(of(i, "u"), F.lit(0)).alias(f"unique_{t}")]
        if ordered:
            out.append(of(i, "x").alias(f"example_{t}"))
    return by_tag.agg(*out)


def count_by(tagged: DataFrame, tag: str) -> DataFrame:
    """Reads for each value of a tag; reads without it are left out."""
    # A filter on the tag would go below its making and have it made twice.
    return tagged.groupBy(tag).agg(F.count(tag).alias("n_reads")).filter("n_reads > 0")


def md_rate(reads: DataFrame, sample: int = 100, least: float = 0.1) -> DataFrame:
    """One row: whether MD tags are frequent among the first ``sample`` mapped reads (one at least)."""
    text = F.col("md") if "md" in reads.columns else F.col("tags")["MD"]["value"]
    mapped = reads.filter(F.col("flag").bitwiseAND(4) == 0)
    if "ord" in reads.columns:
        mapped = mapped.orderBy("ord")
    n, k = F.count("*"), F.count_if("has")
    return mapped.select(text.isNotNull().alias("has")).limit(sample).agg(n.alias("n_sampled"), k.alias("n_md"), ((k > 0) & (k / F.greatest(n, F.lit(1)) >= least)).alias("has_md"))


def observed(tagged: DataFrame, observation: Observation | str = "tagging") -> DataFrame:
    """The same rows; reads and tagged reads are counted while they pass, so a run's report costs no second pass.

    With an Observation the counts are in ``observation.get`` after the first action; by a name they reach the listeners of a stream."""
    return tagged.observe(observation, F.count(F.lit(1)).alias("total_reads"), F.count_if("tagged").alias("processed_reads"), F.count_if(F.col("tagged") & (F.size("exons") == 1)).alias("single_exon_reads"))
