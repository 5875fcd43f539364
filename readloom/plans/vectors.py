"""Queries whose values SQL cannot compute: inputs of few kinds, taken from the tables, against what hashlib and json give for each kind.

SHA-512 is the digest of all identifiers, and DuckDB lacks it. So each SQL here holds a table of the kinds of input with
their digests, made by the plain functions below, and joins it to the same rows that the query reads."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from readloom.config import TagConfig
from readloom.functions import hashing
from readloom.functions.hashing import bare_accession, sha512t24u
from readloom.operators import reference, refget, tags
from readloom.plans.synth import digest, table
from readloom.sources.mapping import malformed
from readloom.sources.sam import parse_lines

KNOWN = "SQ.aKF498dAxcJAqme6QYQ7EZ07-fiw8Kw2"
QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def values(rows, names: str) -> str:
    text = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS {names}"


def pick(column, choices):
    """One of the choices by a whole number."""
    return F.get(F.array(*[F.lit(x) for x in choices]), (column % len(choices)).cast("int"))


# G1
BRANDS = [f"Brand#{k}" for k in range(1, 26)]


@query("brand_digests", f"SELECT p_partkey, d AS digest FROM part JOIN {values([(b, digest(b)) for b in BRANDS], 't(b, d)')} ON p_brand = b")
def brand_digests(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sha512t24u(F.col("p_brand")).alias("digest"))


# The last contig of a name counts
SEQUENCES = ["ACGT", "acgtn", "ACGTR YKM\nac", "NNNN", "acgu", "TTTTGGGGCCCCAAAA" * 5, " \t", "BDHVSW"]


def _bases(s: str, keep: bool) -> str:
    bare = "".join(s.split()).upper()
    return bare if keep else "".join(c if c in "ACGTN" else "N" for c in bare)


_SEQUENCE_ROWS = [(k, "SQ." + digest(_bases(s, False)), "SQ." + digest(_bases(s, True)), sum(c not in "ACGTN" for c in _bases(s, True))) for k, s in enumerate(SEQUENCES) if s.strip()]


@query("sequence_ids", f"""WITH c AS (SELECT 'c' || (p_partkey % 50) AS name, p_partkey AS ord, (p_partkey // 3) % 8 AS k FROM part WHERE (p_partkey // 3) % 8 <> 6)
SELECT name, masked, kept, n_ambiguous FROM (SELECT name, max_by(k, ord) AS k FROM c GROUP BY name) JOIN (SELECT k, masked, kept, CAST(n AS BIGINT) AS n_ambiguous FROM {values(_SEQUENCE_ROWS, 't(k, masked, kept, n)')}) USING (k)""")
def sequence_ids(spark, sf_dir):
    k = F.col("p_partkey")
    contigs = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), (k % 50).cast("string")).alias("name"), pick(F.floor(k / 3), SEQUENCES).alias("seq"), k.alias("ord"))
    contigs = contigs.filter(F.length(F.regexp_replace("seq", r"\s", "")) > 0)
    masked, kept = refget.from_sequences(contigs), refget.from_sequences(contigs, keep_ambiguous=True)
    return masked.select("name", F.col("refget_id").alias("masked"), "n_ambiguous").join(kept.select("name", F.col("refget_id").alias("kept")), "name")


# What is no accession is told apart before variants are named
ACCESSIONS = [KNOWN, f"ga4gh:{KNOWN}", "SQ.short", "chr1", "", KNOWN + "x", "ga4gh:chr1", "sq." + KNOWN[3:]]


@query("accessions", f"SELECT s_suppkey, id, regexp_full_match(id, '(ga4gh:)?SQ[.][0-9A-Za-z_-]{{32}}') AS good, CASE WHEN regexp_full_match(id, '(ga4gh:)?SQ[.][0-9A-Za-z_-]{{32}}') THEN replace(id, 'ga4gh:', '') END AS bare FROM supplier JOIN {values(list(enumerate(ACCESSIONS)), 't(k, id)')} ON s_suppkey % {len(ACCESSIONS)} = k")
def accessions(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", pick(F.col("s_suppkey"), ACCESSIONS).alias("refget_id"))
    bad = malformed(rows).select("s_suppkey").withColumn("bad", F.lit(True))
    out = rows.join(bad, "s_suppkey", "left").withColumn("good", F.col("bad").isNull())
    return out.select("s_suppkey", F.col("refget_id").alias("id"), "good", F.when(F.col("good"), bare_accession(F.col("refget_id"))).alias("bare"))


# G19-G21
def _plain(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def plain_location(accession: str, start: int, ref: str) -> str:
    return digest(_plain({"type": "SequenceLocation", "start": start, "end": start + len(ref), "sequenceReference": {"type": "SequenceReference", "refgetAccession": accession}}))


def plain_allele(accession: str, start: int, ref: str, alt: str) -> str:
    return "ga4gh:VA." + digest(_plain({"type": "Allele", "location": plain_location(accession, start, ref), "state": {"type": "LiteralSequenceExpression", "sequence": alt}}))


_CHANGES = [("A", "C"), ("G", "T"), ("TT", "GA"), ("C", "T"), ("ACG", "TTT")]
_ALLELES = [(k, k * 104729, *_CHANGES[k % 5]) for k in range(40)]


@query("vrs_alleles", f"SELECT p_partkey, location, allele FROM part JOIN {values([(k, plain_location(KNOWN, s, r), plain_allele(KNOWN, s, r, a)) for k, s, r, a in _ALLELES], 't(k, location, allele)')} ON p_partkey % 40 = k")
def vrs_alleles(spark, sf_dir):
    k = F.col("p_partkey") % 40
    rows = table(spark, sf_dir, "part").select("p_partkey", (k * 104729).cast("long").alias("start"), pick(k, [r for r, _ in _CHANGES]).alias("ref"), pick(k, [a for _, a in _CHANGES]).alias("alt"))
    known = F.lit(KNOWN)
    return rows.select("p_partkey", hashing.location_digest(known, F.col("start"), F.col("ref")).alias("location"), hashing.allele_id(known, F.col("start"), F.col("ref"), F.col("alt")).alias("allele"))


# Reads whose variants are known by their making; ids sorted, without doubles
#: (position, CIGAR, SEQ, MD, substitutions as (0-based start, ref, alt)): every operation, mixes of them, SEQ that is * or empty.
_VARIANT_READS = [
    (100, "10M", "ACGTACGTAC", "4C5", [(103, "C", "A")]), (100, "10M", "ACGTACGTAC", "10", []), (200, "4M3N4M", "ACGTTTTT", "5A2", [(207, "A", "T")]), (300, "2S3M1I3M", "GGACGTACG", "2T3", [(301, "T", "G")]),
    (400, "3M2D3M", "ACGTAC", "3^GG1C1", [(405, "C", "A")]), (500, "3H4=1X3M2P2M", "ACGTACGTAC", "4G5", [(503, "G", "A")]), (600, "5M", "*", "2A2", []), (700, "5M", "", "2A2", []), (800, "6M", "NCGTAC", "0A4G0", [(804, "G", "C")]),
    (900, "4M", "ACGT", None, []), (1000, "3M1I2D3M", "ACGTACG", "0T2^AC0A1C0", [(999, "T", "A"), (1006, "C", "G")]), (50, "8M", "ACGTACGT", "0c1a5", [(49, "C", "A"), (51, "A", "G")]),
]


def _variant_row(k: int):
    subs = _VARIANT_READS[k][4]
    return k, ",".join(sorted({plain_allele(KNOWN, s, r, a) for s, r, a in subs})) or None, len(subs)


@query("variant_tags", f"SELECT n_nationkey, xv, CAST(n AS BIGINT) AS variant_emitted_count FROM nation JOIN {values([_variant_row(k) for k in range(len(_VARIANT_READS))], 't(k, xv, n)')} ON n_nationkey % {len(_VARIANT_READS)} = k")
def variant_tags(spark, sf_dir):
    k = F.col("n_nationkey")
    get = lambda i: pick(k, [r[i] for r in _VARIANT_READS])
    reads = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(0).alias("flag"), pick(k, ["chr1", "1"]).alias("rname"), get(0).cast("long").alias("pos"), get(1).alias("cigar"), get(2).alias("seq"), get(3).alias("md"))
    names = spark.sql(f"SELECT * FROM VALUES ('chr1', '{KNOWN}'), ('1', '{KNOWN}') AS t(name, refget_id)")
    return tags.tag_reads(reads, names, variants=True).select("n_nationkey", "xv", "variant_emitted_count")


# Text lines to all tags, against digests fixed beforehand
_C = "aKF498dAxcJAqme6QYQ7EZ07-fiw8Kw2"
#: (flag, name, position, CIGAR), and the texts that are hashed behind the chromosome's digest: XI, XT, XC, X5, X3; the XB and XS.
_GOLDEN = [
    (0, "chr1", 1000, "200M2000N150M", "+|1000:1199|3200:3349", "+|0|0|2000|1199|3200", "+|2|20|15", "+|5", "+|16", "aKF498dAp.3e8.d15", "aKF498dAp.4af.c80"),
    (16, "chr1", 1000, "200M2000N150M", "-|1000:1199|3200:3349", "-|0|0|2000|1199|3200", "-|2|20|15", "-|16", "-|5", "aKF498dAm.3e8.d15", "aKF498dAm.4af.c80"),
    (0, "chr1", 15000, "5S500M3I2D498M4H", "+|15000:15999", "+|20000|1000|1000", "+|15|100", "+|75", "+|79", "aKF498dAp.3a98.3e7f", "single"),
    (0, "chr1", 1000, "5N10M", "+|1000:999|1005:1014", "+|0|0|0|999|1005", "+|1|0|1", "+|5", "+|5", "aKF498dAp.3e8.3f6", "aKF498dAp.3e7.3ed"),
    (0, "chrX", 1000, "100M", "+|1000:1099", "+|0|0|0", "+|1|10", "+|5", "+|5", "MXPwVkq5p.3e8.44b", "single"),
    (4, "chr1", 1000, "100M", None, None, None, None, None, None, None), (0, "chr1", 1000, "*", None, None, None, None, None, None, None), (256, "chr1", 1000, "10M", None, None, None, None, None, None, None),
]


def _golden_row(k: int):
    own = digest("X") if _GOLDEN[k][1] == "chrX" else _C
    return k, *(x and digest(f"{own}|{x}") for x in _GOLDEN[k][4:9]), *_GOLDEN[k][9:]


@query("golden_tags", f"SELECT n_nationkey, xi, xt, xc, x5, x3, xb, xs FROM nation JOIN {values([_golden_row(k) for k in range(len(_GOLDEN))], 't(k, xi, xt, xc, x5, x3, xb, xs)')} ON n_nationkey % {len(_GOLDEN)} = k")
def golden_tags(spark, sf_dir):
    k = F.col("n_nationkey")
    parts = ["q", *[pick(k, [str(r[i]) for r in _GOLDEN]) for i in range(4)]]
    text = F.concat_ws("\t", F.lit(parts[0]), *parts[1:4], F.lit("60"), parts[4], *[F.lit(x) for x in ("*", "0", "0", "*", "*")])
    lines = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("value"))
    names = spark.sql(f"SELECT * FROM VALUES ('chr1', 'ga4gh:{KNOWN}'), ('1', 'ga4gh:{KNOWN}') AS t(name, refget_id)")
    return tags.tag_reads(parse_lines(lines), names, TagConfig(primary_only=True)).select("n_nationkey", "xi", "xt", "xc", "x5", "x3", "xb", "xs")


# MD from the reference for every operation and mixes of them, over the edge of a tile and past a contig's end
_CONTIG = "ACGGT" * 30
#: (position, CIGAR, SEQ)
_MD_READS = [
    (1, "10M", "ACGGTACGGT"), (1, "10M", "ACGTTACGGA"), (4, "3M2I4M", "GTATTCGGT"), (2, "4M3D5M", "CGGTGTACG"), (5, "2S3M5N4M2H", "TTTACACGA"), (11, "3=2X4M", "ACGACACGG"), (3, "2M1I1D3M2N3M1P2M", "GGATACCGGTAC"),
    (60, "8M2D8M", "TACGGTACTACGGTCC"), (144, "10M", "GTACGGTACG"), (20, "5M", "*"), (30, "1D4M", "GGTA"), (6, "6M", "acgNta"),
]


def plain_md(pos: int, cigar: str, seq: str, contig: str = _CONTIG) -> str | None:
    """Base by base; what reaches past the contig's end is left out."""
    import re

    if seq == "*":
        return None
    out, same, r, q = "", 0, pos - 1, 0
    for n, o in [(int(n), o) for n, o in re.findall(r"(\d+)(\D)", cigar)]:
        if o in "M=X":
            for k in range(n):
                if r + k < len(contig):
                    own, ref = seq[q + k].upper(), contig[r + k]
                    out, same = (out, same + 1) if own == ref else (f"{out}{same}{ref}", 0)
        if o == "D":
            out, same = f"{out}{same}^{contig[r : r + n]}", 0
        r += n if o in "M=XDN" else 0
        q += n if o in "M=XIS" else 0
    return f"{out}{same}"


@query("md_mixed", f"SELECT p_partkey AS ord, md FROM part JOIN {values([(k, plain_md(*r)) for k, r in enumerate(_MD_READS)], 't(k, md)')} ON p_partkey % {len(_MD_READS)} = k")
def md_mixed(spark, sf_dir):
    k = F.col("p_partkey")
    get = lambda i: pick(k, [r[i] for r in _MD_READS])
    reads = table(spark, sf_dir, "part").select(k.alias("ord"), F.lit(0).alias("flag"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("rname"), get(0).cast("long").alias("pos"), get(1).alias("cigar"), get(2).alias("seq"))
    contigs = spark.range(2).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"), F.repeat(F.lit("ACGGT"), F.lit(30)).alias("seq"))
    return reference.with_md(reads, contigs, 64).select("ord", "md")
