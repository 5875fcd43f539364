"""Read ends against sets of known sites: a range join by bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.joins import apart

#: Bins of known sites that may be broadcast, some 100 bytes each.
BROADCAST_BINS = 500_000


def ends(structured: DataFrame, five: bool) -> DataFrame:
    """structured (exons, strand, tagged) with ``site``: the 5' or 3' end of each tagged read."""
    e = F.col("exons")
    left, right = F.get(e, F.lit(0))["start"], F.try_element_at(e, F.lit(-1))["end"]
    return structured.filter("tagged").withColumn("site", F.when((F.col("strand") == "+") == F.lit(five), left).otherwise(right))


def near_sites(reads: DataFrame, sites: DataFrame, within: int = 100) -> DataFrame:
    """reads (rname, strand, site, …) with ``hit``: whether a known site (rname, strand, at) lies within so many bases.

    Positions are binned at twice the reach; a known site stands in each bin that its reach touches (two at most), and a
    bin holds its sites as one array of at most ``4 * within + 1`` positions. So the join is on equal bins and gives one
    row a read. Few bins are sent to the reads, which stay where they are; many are joined so that AQE can deal out the
    reads of a busy place."""
    width = 2 * within + 1
    low, high = F.floor((F.col("at") - within) / width), F.floor((F.col("at") + within) / width)
    known = sites.select("rname", "strand", "at").distinct().withColumn("__bin", F.explode(F.sequence(low, high))).groupBy("rname", "strand", "__bin").agg(F.collect_set("at").alias("__at"))
    known = F.broadcast(known) if known.limit(BROADCAST_BINS + 1).count() <= BROADCAST_BINS else apart(known, "rname", "strand", "__bin")
    out = reads.withColumn("__bin", F.floor(F.col("site") / width)).join(known, ["rname", "strand", "__bin"], "left")
    hit = F.exists("__at", lambda at: F.abs(F.col("site") - at) <= within)
    return out.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("__bin", "__at")
