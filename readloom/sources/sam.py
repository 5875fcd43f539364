"""SAM text as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import __version__
from readloom.sources.files import in_order

FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
TYPES = {"flag": "int", "pos": "bigint", "mapq": "int", "pnext": "bigint", "tlen": "bigint"}
TAGS = "map<string,struct<type:string,value:string>>"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records of text lines; header lines and lines of fewer than 11 fields are left out. Other columns stay."""
    f = F.split(F.col(column), "\t")
    out = lines.filter(~F.startswith(F.col(column), F.lit("@"))).withColumn("__f", f).filter(F.size("__f") >= 11)
    values = {name: F.get("__f", F.lit(i)).cast(TYPES.get(name, "string")) for i, name in enumerate(FIELDS)}
    optional = F.filter(F.slice("__f", 12, 1 << 20), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    # Of two tags of one name the first counts.
    pairs = F.transform(optional, lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.struct(F.substring(x, 4, 1).alias("type"), F.substring(x, 6, 1 << 30).alias("value")).alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return out.withColumns(values | {"tags": F.map_from_entries(first)}).drop("__f", column)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).withColumn("ord", F.monotonically_increasing_id())


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records with ``file`` and ``ord``; ord rises in the order of the input."""
    return parse_lines(_lines(spark, path))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(line, ord) of header lines."""
    return _lines(spark, path).filter(F.startswith("value", F.lit("@"))).select(F.col("value").alias("line"), "ord")


def with_program(header: DataFrame, command: str, name: str = "readloom") -> DataFrame:
    """The header with one more @PG line at its end."""
    spark = header.sparkSession
    last = header.agg(F.coalesce(F.max("ord"), F.lit(-1)) + 1).first()[0]
    line = "\t".join(["@PG", f"ID:{name}", f"PN:{name}", f"VN:{__version__}", f"CL:{command}"])
    return header.unionByName(spark.createDataFrame([(line, last)], "line string, ord bigint"))


def to_line(columns: list[str]) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("0" if c in TYPES else "*")) for c in FIELDS]
    if "tags" not in columns:
        return F.concat_ws("\t", *parts)
    tags = F.transform(F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast(TAGS)))), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"]))
    return F.concat_ws("\t", *parts, tags)


def write_sam(reads: DataFrame, path: str, header: DataFrame | None = None, order: str = "ord", single: bool = False) -> None:
    """Writes every read in input order: part files in order of name, the header in the first. ``single`` makes one file."""
    body = reads.select(F.col(order).alias("ord"), to_line(reads.columns).alias("value"), F.lit(1).alias("k"))
    if header is not None:
        body = header.select("ord", F.col("line").alias("value"), F.lit(0).alias("k")).unionByName(body)
    # Header lines have one key, which no two ranges share.
    body = body.coalesce(1).sortWithinPartitions("k", "ord") if single else in_order(body, F.when(F.col("k") == 1, F.col("ord")), "k", "ord")
    body.select("value").write.mode("overwrite").text(path)
