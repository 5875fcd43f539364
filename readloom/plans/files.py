"""Queries that go through files: tables are written in a format of the field below the scratch folder and read back.

Not in ``registry``, whose plans stay in the JVM: BAM records are read by Python code."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.operators import refget, tags
from readloom.plans import registry, vectors
from readloom.plans.synth import mapping, reads_from_orders, reads_sql, table
from readloom.sources import bam, fasta, sam
from readloom.sources import mapping as mappings
from readloom.sources.files import scratch

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


HEADER = "@HD\tVN:1.6\tSO:unsorted\n" + "\n".join(f"@SQ\tSN:chr{k}\tLN:400000000" for k in range(1, 20))


def alignments(spark, sf_dir):
    """The reads of the orders with every field of a record."""
    reads = reads_from_orders(spark, sf_dir, even=False)
    none = {c: F.lit(None).cast(t) for c, t in (("mapq", "int"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("qual", "string"))}
    md = F.when(F.col("md").isNotNull(), F.create_map(F.lit("MD"), F.struct(F.lit("Z").alias("type"), F.col("md").alias("value"))))
    return reads.withColumns(none | {"tags": md})


def written_bam(spark, sf_dir, single: bool = True) -> str:
    path = scratch(spark, "orders") + ".bam"
    bam.write_bam(alignments(spark, sf_dir), path, HEADER, single=single)
    return path


# A1, A3, A4: one BAM file, written by many tasks and read by many, fields and tags
@query("bam_fields", reads_sql("SELECT qname, CAST(flag AS INTEGER) AS flag, rname, pos, cigar, CAST(size AS INTEGER) AS seq_length, md FROM reads"))
def bam_fields(spark, sf_dir):
    reads = bam.read_bam(spark, written_bam(spark, sf_dir), columns=["qname", "flag", "rname", "pos", "cigar", "seq", "tags"])
    return reads.select("qname", "flag", "rname", "pos", "cigar", F.length("seq").alias("seq_length"), F.col("tags")["MD"]["value"].alias("md"))


# Tags of reads that come from a folder of BAM files
@query("bam_tags", reads_sql("SELECT qname, chr8 || pm || '.' || lower(to_hex(left_)) || '.' || lower(to_hex(right_)) AS xb, coalesce(chr8 || pm || '.' || junction_hex, 'single') AS xs FROM tagged"))
def bam_tags(spark, sf_dir):
    reads = bam.read_bam(spark, written_bam(spark, sf_dir, False), columns=["qname", "flag", "rname", "pos", "cigar"])
    return tags.tag_reads(reads, mapping(spark)).filter("tagged").select("qname", "xb", "xs")


# A2, A3, A4: SAM text with a header
@query("sam_file", reads_sql("SELECT qname, CAST(flag AS INTEGER) AS flag, pos, cigar, md, 21 AS header_lines FROM reads"))
def sam_file(spark, sf_dir):
    path = scratch(spark, "orders-sam")
    lines = spark.createDataFrame([(x, i) for i, x in enumerate(HEADER.splitlines())], "line string, ord bigint")
    sam.write_sam(alignments(spark, sf_dir), path, sam.with_program(lines, "sam_file"))
    n = sam.read_header(spark, path).count()
    return sam.read_sam(spark, path).select("qname", "flag", "pos", "cigar", F.col("tags")["MD"]["value"].alias("md"), F.lit(n).cast("int").alias("header_lines"))


# Two mapping files of one name; the file that is named first counts
_FILES_SQL = registry._TWO_SQL + ", k AS (SELECT name, refget_id, file_ord, row_number() OVER (PARTITION BY file_ord ORDER BY name) AS key_ord FROM (SELECT name, max_by(refget_id, key_ord) AS refget_id, file_ord FROM m GROUP BY name, file_ord))"


@query("mapping_files", f"""{_FILES_SQL},
f AS (SELECT name, arg_min(refget_id, file_ord * 1000000 + key_ord) AS refget_id, min(file_ord * 1000000 + key_ord) AS seen_at FROM k GROUP BY name),
b AS (SELECT * FROM f WHERE NOT (regexp_full_match(name, '(chr|Chr|CHR)?[0-9]+') AND CAST(regexp_extract(name, '[0-9]+$') AS BIGINT) > 30)),
s AS (SELECT refget_id, min(seen_at) AS seen FROM b GROUP BY 1),
v AS (SELECT b.refget_id, seen, unnest({registry._SPELL_SQL}) AS name FROM b JOIN s ON b.refget_id = s.refget_id)
SELECT name, max_by(refget_id, seen) AS refget_id FROM v GROUP BY name""")
def mapping_files(spark, sf_dir):
    two, folder = registry.two_mappings(spark, sf_dir), scratch(spark, "mappings")
    paths = [f"{folder}/{k}/names.json" for k in (1, 0)]
    for k, path in enumerate(paths):
        one = two.filter(F.col("file_ord") == k).groupBy("name").agg(F.max_by("refget_id", "key_ord").alias("refget_id"))
        mappings.save_mapping(one, path, f"genome{k}", True)
    return refget.merge(mappings.read_mapping(spark, paths))


# FASTA text
@query("fasta_file", f"SELECT 'c' || p_partkey AS name, masked AS refget_id, CAST(n AS BIGINT) AS n_ambiguous FROM part JOIN {vectors.values(vectors._SEQUENCE_ROWS, 't(k, masked, kept, n)')} ON p_partkey % 8 = k")
def fasta_file(spark, sf_dir):
    k, path = F.col("p_partkey"), scratch(spark, "fasta")
    contigs = table(spark, sf_dir, "part").select(k, F.concat(F.lit(">c"), k.cast("string"), F.lit(" of part\n"), vectors.pick(k, vectors.SEQUENCES)).alias("value"))
    contigs.orderBy("p_partkey").select("value").write.text(path)
    return refget.from_sequences(fasta.read_fasta(spark, path)).select("name", "refget_id", "n_ambiguous")
