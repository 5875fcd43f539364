"""FASTA as DataFrames: one row for a contig."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, ord): the name is the header's first word; white space is taken out of the sequence.

    Text before the first header, and contigs without a sequence, are left out."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("file", F.col("_metadata.file_path")).withColumn("block", F.col("_metadata.file_block_start")).withColumn("ord", F.monotonically_increasing_id())
    # Only a file's first record keeps its mark; if it has none, it is text before the first header. Small files share a
    # task, so a file's first record is found by its number, not by its place in the task.
    marked = F.startswith("value", F.lit(">"))
    first = raw.filter(F.col("block") == 0).groupBy("file").agg(F.min_by(F.struct("ord", (~marked).alias("bare")), "ord").alias("f")).filter("f.bare").select(F.col("f.ord").alias("ord"))
    text = F.when(marked, F.substring("value", 2, (1 << 31) - 2)).otherwise(F.col("value"))
    rows = raw.join(F.broadcast(first), "ord", "left_anti").withColumn("value", text)
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    rows = rows.select(F.get(F.split(F.trim(head), r"\s+"), F.lit(0)).alias("name"), F.regexp_replace(F.col("value").substr(F.length(head) + 1, F.length("value")), r"\s", "").alias("seq"), "ord")
    return rows.filter((F.col("name") != "") & (F.length("seq") > 0))


def fasta_headers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names of all headers."""
    lines = spark.read.text(path).filter(F.startswith("value", F.lit(">")))
    return lines.select(F.get(F.split(F.trim(F.substring("value", 2, (1 << 31) - 2)), r"\s+"), F.lit(0)).alias("name")).filter("name <> ''").distinct()
