"""Command line: ``python -m readloom tag | refget | decode``. Input and output suffixes say SAM, BAM or Parquet."""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.config import CLUSTER_MODES, TagConfig
from readloom.operators import decode, reference, stats, tags
from readloom.sources import bam, fasta, mapping, sam


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Reads and the header's text."""
    low = path.rstrip("/").lower()
    if low.endswith(".bam"):
        return bam.read_bam(spark, path), bam.bam_header(path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path), ""
    return sam.read_sam(spark, path), "\n".join(r.line for r in sam.read_header(spark, path).orderBy("ord").collect())


def keeps_order(reads: DataFrame) -> bool:
    """Whether rows are still where they were read: then part after part is the order of the input, and nothing has to be sorted."""
    plan = reads._jdf.queryExecution().executedPlan().toString()
    return re.search(r"\bExchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan) is None


def _write(reads: DataFrame, path: str, header: str) -> None:
    spark, low = reads.sparkSession, path.rstrip("/").lower()
    if low.endswith(".parquet"):
        reads.write.mode("overwrite").parquet(path)
        return
    lines = spark.createDataFrame([(x, i) for i, x in enumerate(header.splitlines())], "line string, ord bigint")
    lines = sam.with_program(lines, " ".join(sys.argv))
    if low.endswith(".bam"):
        bam.write_bam(reads, path, "\n".join(r.line for r in lines.orderBy("ord").collect()), None if keeps_order(reads) else "ord", single=True)
    else:
        sam.write_sam(reads, path, lines)


def tag(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Tags a file; the policy on variants is settled before any work. Returns the statistics."""
    config = TagConfig(**{k: getattr(a, k) for k in ("clustermode", "position_quantum", "span_quantum", "exon_quantum", "xc_bin_size", "xc_position_quantum", "x5x3_bin_size", "xc_midpoint_only")})
    reads, header = _read(spark, a.input)
    names = mapping.load_or_build(spark, a.refget, a.genome, a.cache, a.keep_ambiguous_bases)
    masked = None
    if a.refget:
        masked = mapping.read_metadata(spark, a.refget).select(F.coalesce("ambiguous_bases_masked", F.lit(True))).first()[0]
        if not masked and a.no_variants:
            print("note: this mapping's sequences were not masked; its tags differ from those of a masked one", file=sys.stderr)
    elif a.genome:
        masked = not a.keep_ambiguous_bases
    variants = tags.variant_policy(reads, masked, a.no_variants, bool(a.genome), names is not None)
    if variants and (bad := mapping.malformed(names).limit(5).collect()):
        raise ValueError(f"not refget accessions: {', '.join(f'{r.name} {r.refget_id}' for r in bad)}")
    if variants and a.genome:
        reads = reference.with_md(reads, fasta.read_fasta(spark, a.genome))
    tagged = tags.tag_reads(reads, names, config, variants)
    _write(tags.set_tags(tagged).select(*[c for c in (*sam.FIELDS, "tags", "file", "ord") if c in tagged.columns or c == "tags"]), a.output, header)
    return stats.tag_stats(tagged)


def refget(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    if a.test:
        from readloom.functions.hashing import refget_id

        made = spark.range(1).select(refget_id(F.lit("ACGT")).alias("refget_id"))
        if made.first()[0] != "SQ.aKF498dAxcJAqme6QYQ7EZ07-fiw8Kw2":
            raise SystemExit("the digest of ACGT is wrong")
        return made
    if not a.output or not (a.merge or a.fasta):
        raise SystemExit("refget takes --output and either --fasta or --merge with two files or more")
    return mapping.merge(spark, a.merge, a.output, a.genome) if a.merge else mapping.build(spark, a.fasta, a.output, a.genome, a.keep_ambiguous_bases)


def decoded(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    names = mapping.read_mapping(spark, a.refget) if a.refget else None
    if not a.boundarytag and decode.is_single_text(a.splicetag):
        raise SystemExit("decode takes --boundarytag or --splicetag")
    rows = spark.createDataFrame([(a.boundarytag, a.splicetag)], "xb string, xs string")
    return decode.decode_tags(rows, names) if a.boundarytag else decode.decode_splice(rows, names)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="readloom", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    t = sub.add_parser("tag", help="tag the reads of a file")
    t.add_argument("-i", "--input", required=True)
    t.add_argument("-o", "--output", required=True)
    t.add_argument("-g", "--genome", help="FASTA: for the mapping, and for MD tags")
    t.add_argument("-r", "--refget", help="mapping file (JSON)")
    t.add_argument("--cache", help="folder for mappings made from FASTA files")
    t.add_argument("--no-variants", action="store_true")
    t.add_argument("--keep-ambiguous-bases", action="store_true")
    t.add_argument("--clustermode", choices=CLUSTER_MODES, default="middle")
    for name, size in (("position-quantum", 10_000), ("span-quantum", 1_000), ("exon-quantum", 1_000), ("xc-bin-size", 10), ("xc-position-quantum", 1_000), ("x5x3-bin-size", 200)):
        t.add_argument(f"--{name}", type=int, default=size)
    t.add_argument("--xc-midpoint-only", action="store_true")
    t.set_defaults(run=tag)
    r = sub.add_parser("refget", help="make or merge mapping files")
    r.add_argument("-f", "--fasta")
    r.add_argument("-o", "--output")
    r.add_argument("-g", "--genome", default="")
    r.add_argument("--keep-ambiguous-bases", action="store_true")
    r.add_argument("--merge", nargs="+")
    r.add_argument("--test", action="store_true")
    r.set_defaults(run=refget)
    d = sub.add_parser("decode", help="decode reversible tags")
    d.add_argument("-b", "--boundarytag")
    d.add_argument("-s", "--splicetag")
    d.add_argument("-r", "--refget")
    d.set_defaults(run=decoded)
    return out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("readloom").getOrCreate()
    shown = a.run(spark, a)
    if shown is not None:
        for row in shown.limit(20).toJSON().collect():
            print(row)


if __name__ == "__main__":
    main()
