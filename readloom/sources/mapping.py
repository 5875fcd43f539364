"""Mapping files (JSON) and their cache."""

from __future__ import annotations

import json
import re
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.hashing import ACCESSION
from readloom.operators import refget
from readloom.sources.fasta import read_fasta
from readloom.sources.files import filesystem

META = "struct<genome:string,generated:string,total_sequences:int,total_mappings:int,ambiguous_bases_masked:boolean,description:string,source_genomes:array<string>,source_files:array<string>>"


def _parsed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each file, in the order of ``paths``, whatever the files are called."""
    every = [paths] if isinstance(paths, str) else paths
    rows = reduce(DataFrame.unionByName, [spark.read.text(p, wholetext=True).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.lit(k).alias("file_ord")) for k, p in enumerate(every)])
    return rows.select("file", "file_ord", F.from_json("value", f"metadata {META}, refget_mapping map<string,string>").alias("j"))


def read_mapping(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, refget_id, file_ord, key_ord) of one or more files; a ga4gh: in front of an id is taken off. No mapping gives no rows."""
    rows = _parsed(spark, paths).select("file_ord", F.posexplode("j.refget_mapping").alias("key_ord", "name", "refget_id"))
    return rows.select("name", F.regexp_replace("refget_id", "^ga4gh:", "").alias("refget_id"), "file_ord", "key_ord")


def malformed(mapping: DataFrame) -> DataFrame:
    """Rows whose id is no accession. They give structure tags by the fallback, but no variant can be named on them."""
    return mapping.filter(~F.coalesce(F.col("refget_id").rlike(ACCESSION), F.lit(False)))


def read_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _parsed(spark, paths).select("file", "file_ord", "j.metadata.*")


def to_json(mapping: DataFrame, genome: str, masked: bool, description: str = "Refget SQ identifiers by sequence name", **more) -> str:
    """The file's text: sorted keys, indented by two. A mapping has thousands of rows at most."""
    names = {r.name: r.refget_id for r in mapping.select("name", "refget_id").collect()}
    meta = {"ambiguous_bases_masked": masked, "description": description, "generated": datetime.now().isoformat(), "genome": genome, "total_mappings": len(names), "total_sequences": len(set(names.values()))} | more
    return json.dumps({"metadata": meta, "refget_mapping": names}, indent=2, sort_keys=True)


def write_text(path: str, text: str) -> None:
    system, place = filesystem(path)
    if "/" in place:
        system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place) as f:
        f.write(text.encode())


def save_mapping(mapping: DataFrame, path: str, genome: str, masked: bool, **more) -> None:
    write_text(path, to_json(mapping, genome, masked, **more))


def build(spark: SparkSession, fasta: str, output: str | None = None, genome: str = "", keep_ambiguous: bool = False) -> DataFrame:
    """The mapping (name, refget_id), spellings included, of a FASTA file."""
    mapping = refget.with_variants(refget.from_sequences(read_fasta(spark, fasta), keep_ambiguous))
    if output:
        save_mapping(mapping, output, genome, not keep_ambiguous)
    return mapping


def merge(spark: SparkSession, paths: list[str], output: str, genome: str) -> DataFrame:
    """Merges two or more mapping files; whether bases are masked follows from the inputs."""
    if len(paths) < 2:
        raise ValueError("merging takes two mapping files or more")
    merged, meta = refget.merge(read_mapping(spark, paths)), refget.merged_metadata(read_metadata(spark, paths)).first()
    save_mapping(merged, output, genome, meta.ambiguous_bases_masked, source_genomes=meta.source_genomes, source_files=meta.source_files, total_sequences=meta.total_sequences)
    return merged


def cache_path(spark: SparkSession, folder: str, fasta: str, keep_ambiguous: bool) -> str:
    """A path that follows the file's content (as far as size and time of change tell it) and the mask flag."""
    target = spark._jvm.org.apache.hadoop.fs.Path(fasta)
    state = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target)
    stem = re.sub(r"\.[^.]*$", "", fasta.rsplit("/", 1)[-1])
    return f"{folder.rstrip('/')}/{stem}-{state.getLen()}-{state.getModificationTime()}-{'kept' if keep_ambiguous else 'masked'}.parquet"


def load_or_build(spark: SparkSession, json_path: str | None = None, fasta: str | None = None, folder: str | None = None, keep_ambiguous: bool = False) -> DataFrame | None:
    """A given mapping file first; none without a genome; else the cached mapping, made if it isn't there."""
    if json_path:
        return read_mapping(spark, json_path).select("name", "refget_id")
    if not fasta:
        return None
    if not folder:
        return build(spark, fasta, keep_ambiguous=keep_ambiguous)
    path = cache_path(spark, folder, fasta, keep_ambiguous)
    target = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        build(spark, fasta, keep_ambiguous=keep_ambiguous).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
