"""Queries over the provided tables, with oracle SQL. Each names the inventory ids it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.config import TagConfig
from readloom.functions import bins, cigar, md
from readloom.functions.hashing import ambiguous_count, mask_ambiguous, normalize_substitution
from readloom.operators import decode, reference, refget, sites, stats, tags
from readloom.plans import synth, vectors
from readloom.plans.synth import mapping, reads_from_events, reads_from_orders, reads_sql, table
from readloom.sources.sam import parse_lines, to_line
from readloom.streaming.tagging import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def structured(spark: SparkSession, sf_dir: str, config: TagConfig = TagConfig()) -> DataFrame:
    return tags.with_structure(reads_from_orders(spark, sf_dir), mapping(spark), config)


def serials(spark: SparkSession, sf_dir: str, config: TagConfig = TagConfig()) -> DataFrame:
    return tags.with_serials(structured(spark, sf_dir, config), config).filter("tagged")


def exploded(frame: DataFrame, values, *keep: str) -> DataFrame:
    """(keep, k from 1, x) of an array. The outer form, as the inner one would have the array made a second time for a filter below it."""
    out = frame.select(*keep, F.posexplode_outer(values).alias("k", "x")).filter("k is not null")
    return out.select(*keep, (F.col("k") + 1).cast("long").alias("k"), "x")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tags.tag_reads(reads_from_orders(spark, sf_dir), mapping(spark))
    return tagged.select("qname", "rname", "pos", "strand", *[t for t in tags.TAGS if t != "xv"])


# operations
@query("cigar_ops", reads_sql("SELECT ord, k, n, o FROM ops"))
def cigar_ops(spark, sf_dir):
    return exploded(structured(spark, sf_dir), "ops", "ord").select("ord", "k", "x.n", "x.o")


# F2, B1, B3
@query("exons", reads_sql('SELECT ord, i, s AS "start", e AS "end" FROM exi'))
def exons(spark, sf_dir):
    return exploded(structured(spark, sf_dir), "exons", "ord").select("ord", F.col("k").alias("i"), "x.start", "x.end")


# F7, D7
@query("transcript_metrics", reads_sql('SELECT ord, left_ AS "start", right_ AS "end", exon_total, right_ - left_ AS span FROM tagged'))
def transcript_metrics(spark, sf_dir):
    e = F.col("exons")
    start, end = cigar.first_start(e), cigar.last_end(e)
    return structured(spark, sf_dir).filter("tagged").select("ord", start.alias("start"), end.alias("end"), cigar.total_length(e).alias("exon_total"), (end - start).alias("span"))


# G9
@query("xi_serial", reads_sql("SELECT ord, chr32 || '|' || strand || '|' || exon_text AS xi_serial FROM tagged"))
def xi_serial(spark, sf_dir):
    return serials(spark, sf_dir).select("ord", "xi_serial")


# G10, G11, C1-C3, B4, B7
@query("xb_xs", reads_sql("SELECT ord, chr8 || pm || '.' || lower(to_hex(left_)) || '.' || lower(to_hex(right_)) AS xb, coalesce(chr8 || pm || '.' || junction_hex, 'single') AS xs FROM tagged"))
def xb_xs(spark, sf_dir):
    return serials(spark, sf_dir).select("ord", "xb", "xs")


# G12, G8, G5, G6
_POSITION = {
    "middle": "CAST(round_even(CAST((left_ + right_) // 2 AS DOUBLE) / 10000, 0) AS BIGINT) * 10000",
    "5prime": "CASE WHEN strand = '+' THEN left_ // 10000 * 10000 ELSE (right_ + 9999) // 10000 * 10000 END",
    "3prime": "CASE WHEN strand = '+' THEN (right_ + 9999) // 10000 * 10000 ELSE left_ // 10000 * 10000 END",
}
for _mode, _at in _POSITION.items():
    _near = lambda x: f"CAST(round_even(CAST({x} AS DOUBLE) / 1000, 0) AS BIGINT) * 1000"

    @query(f"xt_serial_{_mode}", reads_sql(f"SELECT ord, chr32 || '|' || strand || '|' || ({_at}) || '|' || ({_near('exon_total')}) || '|' || ({_near('right_ - left_')}) || coalesce('|' || junction_text, '') AS xt_serial FROM tagged"))
    def _xt(spark, sf_dir, mode=_mode):
        return serials(spark, sf_dir, TagConfig(clustermode=mode)).select("ord", "xt_serial")


# G13, G7
@query("xc_serial", reads_sql("SELECT ord, chr32 || '|' || strand || '|' || ((left_ + right_) // 2 // 1000) || '|' || len_text AS xc_serial FROM tagged"))
def xc_serial(spark, sf_dir):
    return serials(spark, sf_dir).select("ord", "xc_serial")


@query("xc_midpoint_only", reads_sql("SELECT ord, chr32 || '|' || strand || '|' || ((left_ + right_) // 2 // 1000) AS xc_serial FROM tagged"))
def xc_midpoint_only(spark, sf_dir):
    return serials(spark, sf_dir, TagConfig(xc_midpoint_only=True)).select("ord", "xc_serial")


# G14
@query("x5_x3_serials", reads_sql("SELECT ord, chr32 || '|' || strand || '|' || ((CASE WHEN strand = '+' THEN left_ ELSE right_ END) // 200) AS x5_serial, chr32 || '|' || strand || '|' || ((CASE WHEN strand = '+' THEN right_ ELSE left_ END) // 200) AS x3_serial FROM tagged"))
def x5_x3_serials(spark, sf_dir):
    return serials(spark, sf_dir).select("ord", "x5_serial", "x3_serial")


# G5-G7 on values of both signs
@query("bin_rounding", """
SELECT DISTINCT v, v - ((v % 200) + 200) % 200 AS down_, (v + 199) - (((v + 199) % 200) + 200) % 200 AS up_,
  CAST(round_even(CAST(v AS DOUBLE) / 1000, 0) AS BIGINT) * 1000 AS nearest_, (v - ((v % 10) + 10) % 10) // 10 AS floor_
FROM (SELECT CAST(o_custkey * 37 % 9001 - 4500 AS BIGINT) AS v FROM orders UNION ALL SELECT CAST(o_orderkey % 21 * 500 - 5000 AS BIGINT) FROM orders)""")
def bin_rounding(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = o.select((F.col("o_custkey") * 37 % 9001 - 4500).cast("long").alias("v")).union(o.select((F.col("o_orderkey") % 21 * 500 - 5000).cast("long"))).distinct()
    x = F.col("v")
    return v.select("v", bins.down(x, 200).alias("down_"), bins.up(x, 200).alias("up_"), bins.nearest(x, 1000).alias("nearest_"), bins.floor_div(x, 10).alias("floor_"))


# G15, G16, F8, F9, C4, H6
_SPLIT = "SELECT ord, chr8, strand, left_ AS \"left\", right_ AS \"right\", n_exons - 1 AS n_junctions, exon_total AS total_exon_length, right_ - left_ + 1 AS span, CASE WHEN n_exons > 1 THEN right_ - left_ + 1 - exon_total END AS intron_length, true AS tags_consistent, CASE WHEN EXISTS (SELECT 1 FROM chrom WHERE chrom.chr32 = tagged.chr32) THEN rname ELSE '<chr_hash:' || chr8 || '>' END AS chr_name FROM tagged"


@query("decode_xb_xs", reads_sql(_SPLIT))
def decode_xb_xs(spark, sf_dir):
    out = decode.decode_tags(serials(spark, sf_dir).select("ord", "xb", "xs"), mapping(spark))
    return out.select("ord", "chr8", "strand", "left", "right", "n_junctions", "total_exon_length", "span", "intron_length", "tags_consistent", F.array_join("chr_names", ",").alias("chr_name"))


@query("reconstruct_exons", reads_sql('SELECT ord, i, s AS "start", e AS "end" FROM exi'))
def reconstruct_exons(spark, sf_dir):
    out = decode.decode_tags(serials(spark, sf_dir).select("ord", "xb", "xs"))
    return exploded(out, "exons", "ord").select("ord", F.col("k").alias("i"), "x.start", "x.end")


@query("roundtrip_check", reads_sql("SELECT count(*) AS n_reads, count(*) AS n_same FROM tagged"))
def roundtrip_check(spark, sf_dir):
    out = decode.decode_tags(serials(spark, sf_dir).select("xb", "xs", F.col("exons").alias("was")))
    return out.agg(F.count("*").alias("n_reads"), F.count_if(F.col("exons") == F.col("was")).alias("n_same"))


# C1-C4
_FALLBACK = synth.digest("19")


@query("chrom_lookup", reads_sql("SELECT rname, chr32, chr8, count(*) AS n_reads FROM (SELECT r.rname, coalesce(chr32, '" + _FALLBACK + "') AS chr32, substr(coalesce(chr32, '" + _FALLBACK + "'), 1, 8) AS chr8 FROM reads r LEFT JOIN chrom ON r.rname = chrom.name) GROUP BY ALL"))
def chrom_lookup(spark, sf_dir):
    return tags.with_chromosome(reads_from_orders(spark, sf_dir), mapping(spark)).groupBy("rname", "chr32", "chr8").agg(F.count("*").alias("n_reads"))


# Spellings of supplier-made names; the later entry counts
_NAMES_SQL = "SELECT CASE s_suppkey % 5 WHEN 0 THEN 'chr' || s_suppkey WHEN 1 THEN CAST(s_suppkey AS VARCHAR) WHEN 2 THEN 'NC_' || s_suppkey || '.1' WHEN 3 THEN 'chrUn_' || s_suppkey ELSE 'Chr' || (s_suppkey - 4) END AS name, 'SQ.' || s_nationkey AS refget_id, s_suppkey AS ord FROM supplier"
_SPELL_SQL = """CASE WHEN lower(name) LIKE 'chr%' THEN [name, substr(name, 4), 'chr' || substr(name, 4), 'Chr' || substr(name, 4), 'CHR' || substr(name, 4)]
  WHEN regexp_full_match(name, '[0-9A-Za-z]+') THEN [name, 'chr' || name, 'Chr' || name, 'CHR' || name] ELSE [name] END"""


def names_from_suppliers(spark, sf_dir):
    k = F.col("s_suppkey")
    text = k.cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("chr"), text)).when(k % 5 == 1, text).when(k % 5 == 2, F.concat(F.lit("NC_"), text, F.lit(".1"))).when(k % 5 == 3, F.concat(F.lit("chrUn_"), text)).otherwise(F.concat(F.lit("Chr"), (k - 4).cast("string")))
    return table(spark, sf_dir, "supplier").select(name.alias("name"), F.concat(F.lit("SQ."), F.col("s_nationkey").cast("string")).alias("refget_id"), k.alias("ord"))


@query("alias_variants", f"WITH n AS ({_NAMES_SQL}), v AS (SELECT ord, refget_id, unnest({_SPELL_SQL}) AS name FROM n) SELECT name, max_by(refget_id, ord) AS refget_id FROM v GROUP BY name")
def alias_variants(spark, sf_dir):
    return refget.with_variants(names_from_suppliers(spark, sf_dir))


# Two tables of names, of which the second contradicts the first here and there
_TWO_SQL = f"WITH n AS ({_NAMES_SQL}), m AS (SELECT name, refget_id, 0 AS file_ord, ord AS key_ord FROM n WHERE ord % 3 <> 0 UNION ALL SELECT name, CASE WHEN ord % 4 = 0 THEN 'SQ.other' ELSE refget_id END, 1, ord FROM n WHERE ord % 2 = 0)"
_FIRST_SQL = "f AS (SELECT name, arg_min(refget_id, file_ord * 1000000 + key_ord) AS refget_id, min(file_ord * 1000000 + key_ord) AS seen_at FROM m GROUP BY name)"


def two_mappings(spark, sf_dir):
    n = names_from_suppliers(spark, sf_dir)
    other = F.when(F.col("ord") % 4 == 0, "SQ.other").otherwise(F.col("refget_id"))
    a = n.filter("ord % 3 <> 0").select("name", "refget_id", F.lit(0).alias("file_ord"), F.col("ord").alias("key_ord"))
    return a.union(n.filter("ord % 2 = 0").select("name", other, F.lit(1), "ord"))


@query("mapping_merge", f"""{_TWO_SQL}, {_FIRST_SQL},
b AS (SELECT * FROM f WHERE NOT (regexp_full_match(name, '(chr|Chr|CHR)?[0-9]+') AND CAST(regexp_extract(name, '[0-9]+$') AS BIGINT) > 30)),
s AS (SELECT refget_id, min(seen_at) AS seen FROM b GROUP BY 1),
v AS (SELECT b.refget_id, seen, unnest({_SPELL_SQL}) AS name FROM b JOIN s ON b.refget_id = s.refget_id)
SELECT name, max_by(refget_id, seen) AS refget_id FROM v GROUP BY name""")
def mapping_merge(spark, sf_dir):
    return refget.merge(two_mappings(spark, sf_dir))


@query("mapping_conflicts", f"{_TWO_SQL} SELECT name, count(DISTINCT refget_id) AS n_ids, arg_min(refget_id, file_ord * 1000000 + key_ord) AS kept FROM m GROUP BY name HAVING count(DISTINCT refget_id) > 1")
def mapping_conflicts(spark, sf_dir):
    return refget.conflicts(two_mappings(spark, sf_dir)).select("name", "n_ids", "kept")


# E3
@query("bogus_alias", "SELECT p_partkey, p || k AS name, k > 30 AS bogus FROM (SELECT p_partkey, unnest(['', 'chr', 'Chr', 'CHR', 'chrX', 'NC_']) AS p, p_partkey AS k FROM part) WHERE p NOT IN ('chrX', 'NC_') UNION ALL SELECT p_partkey, p || p_partkey, false FROM (SELECT p_partkey, unnest(['chrX', 'NC_']) AS p FROM part)")
def bogus_alias(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.lit(x) for x in ("", "chr", "Chr", "CHR", "chrX", "NC_")])).alias("p"))
    name = F.concat("p", F.col("p_partkey").cast("string"))
    return rows.select("p_partkey", name.alias("name"), refget.is_bogus(name).alias("bogus"))


# G2, D6, D5 with texts in the place of sequences
_UPPER_SQL = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query("mask_counts", f"SELECT doc_id, length(text) AS n_all, length(regexp_replace({_UPPER_SQL}, '[ACGTN]', '', 'g')) AS n_ambiguous, length(regexp_replace(regexp_replace({_UPPER_SQL}, '[^ACGTN]', 'N', 'g'), '[^N]', '', 'g')) AS n_masked FROM documents")
def mask_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_all"), ambiguous_count(t).alias("n_ambiguous"), F.length(F.regexp_replace(mask_ambiguous(t), "[^N]", "")).cast("long").alias("n_masked"))


# The same counts by the plain rule, without the library's functions.
@query("mask_counts_all")
def mask_counts_all(spark, sf_dir):
    t = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    masked = F.length(F.regexp_replace(F.regexp_replace(t, "[^ACGTN]", "N"), "[^N]", "")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_all"), F.length(F.regexp_replace(t, "[ACGTN]", "")).cast("long").alias("n_ambiguous"), masked.alias("n_masked"))


# F4
@query("md_events", reads_sql("""SELECT ord, off, kind, base FROM (
  SELECT ord, matched // 2 + CASE WHEN ord % 10 = 4 THEN 14 ELSE 0 END AS off, 'X' AS kind, substr('ACGT', CAST(ord % 4 AS INTEGER) + 1, 1) AS base FROM reads WHERE md IS NOT NULL
  UNION ALL SELECT ord, 12 + unnest([0, 1]), 'D', unnest(['G', 'T']) FROM reads WHERE md IS NOT NULL AND ord % 10 = 4)"""))
def md_events(spark, sf_dir):
    rows = exploded(reads_from_orders(spark, sf_dir), md.md_events(F.col("md")), "ord")
    return rows.select("ord", "x.off", "x.kind", "x.base")


# F3, F3a, G22 (candidates), D4
_SNV_SQL = """,
c AS (SELECT m.*, matched // 2 + CASE WHEN ord % 10 = 4 THEN 14 ELSE 0 END AS off, substr('ACGT', CAST(ord % 4 AS INTEGER) + 1, 1) AS ref FROM mapped m WHERE md IS NOT NULL),
seg AS (SELECT ord, o, n, coalesce(sum(CASE WHEN o IN ('M', 'D', 'N') THEN n ELSE 0 END) OVER w, 0)::BIGINT AS r, coalesce(sum(CASE WHEN o IN ('M', 'I', 'S') THEN n ELSE 0 END) OVER w, 0)::BIGINT AS q,
  coalesce(sum(CASE WHEN o IN ('M', 'D') THEN n ELSE 0 END) OVER w, 0)::BIGINT AS m FROM ops WINDOW w AS (PARTITION BY ord ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
snv AS (SELECT c.ord, c.pos - 1 + seg.r + c.off - seg.m AS "start", ref, substr('ACGT', CAST((seg.q + c.off - seg.m) % 4 AS INTEGER) + 1, 1) AS alt FROM c JOIN seg ON c.ord = seg.ord AND seg.o = 'M' AND c.off >= seg.m AND c.off < seg.m + seg.n),
cand AS (SELECT * FROM snv WHERE ref <> alt
  UNION ALL SELECT c.ord, c.pos - 1 + seg.r, '', substr(repeat('ACGT', CAST((seg.q + seg.n) // 4 + 1 AS INTEGER)), CAST(seg.q AS INTEGER) + 1, CAST(seg.n AS INTEGER)) FROM c JOIN seg ON c.ord = seg.ord AND seg.o = 'I'
  UNION ALL SELECT c.ord, c.pos - 1 + seg.r, 'GT', '' FROM c JOIN seg ON c.ord = seg.ord AND seg.o = 'D')
"""


@query("variant_candidates", reads_sql(_SNV_SQL + 'SELECT ord, "start", ref, alt FROM cand'))
def variant_candidates(spark, sf_dir):
    s = structured(spark, sf_dir).filter("tagged")
    rows = exploded(s, md.candidates(F.col("ops"), F.col("pos"), F.col("seq"), F.col("md")), "ord")
    return rows.select("ord", "x.start", "x.ref", "x.alt")


def known_names(spark):
    """The mapping with chr19 in it, as a read with variants on an unknown sequence is an error."""
    return mapping(spark).union(spark.sql(f"SELECT 'chr19' AS name, 'SQ.{synth.digest('synthetic chromosome 19')}' AS refget_id"))


def known_reads(spark, sf_dir):
    """All reads, with variants."""
    return tags.tag_reads(reads_from_orders(spark, sf_dir), known_names(spark), variants=True)


@query("variant_counts", reads_sql(_SNV_SQL + """
SELECT count(*) AS variant_candidates, count(CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 1 END) AS variants_emitted, count(*) - count(CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 1 END) AS variants_skipped,
  count(DISTINCT CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN ord END) AS reads_with_variants FROM cand"""))
def variant_counts(spark, sf_dir):
    # The tags themselves aren't asked for, and tag_stats counts the values of those that are there.
    return stats.tag_stats(known_reads(spark, sf_dir).drop(*tags.TAGS), None).select("variant_candidates", "variants_emitted", "variants_skipped", "reads_with_variants")


# D1-D3
_STAT_SQL = ", ".join(f"(SELECT count(*) FROM tagged) AS tagged_{t}, (SELECT count(DISTINCT {x}) FROM tagged) AS unique_{t}" for t, x in (
    ("xi", "chr32 || strand || exon_text"), ("xb", "chr8 || pm || left_ || '.' || right_"), ("xs", "coalesce(chr8 || pm || junction_hex, 'single')"), ("xc", "chr32 || strand || ((left_ + right_) // 2 // 1000) || '|' || len_text"),
    ("x5", "chr32 || strand || ((CASE WHEN strand = '+' THEN left_ ELSE right_ END) // 200)"), ("x3", "chr32 || strand || ((CASE WHEN strand = '+' THEN right_ ELSE left_ END) // 200)")))


@query("tag_stats", reads_sql(f"SELECT (SELECT count(*) FROM reads) AS total_reads, (SELECT count(*) FROM tagged) AS processed_reads, (SELECT count(*) FROM tagged WHERE n_exons = 1) AS single_exon_reads, {_STAT_SQL}, (SELECT arg_min(coalesce(chr8 || pm || '.' || junction_hex, 'single'), ord) FROM tagged) AS example_xs"))
def tag_stats(spark, sf_dir):
    out = stats.tag_stats(tags.tag_reads(reads_from_orders(spark, sf_dir), mapping(spark)))
    return out.select("total_reads", "processed_reads", "single_exon_reads", *[f"{k}_{t}" for t in ("xi", "xb", "xs", "xc", "x5", "x3") for k in ("tagged", "unique")], "example_xs")


# The hashed tag groups as its serial does
def _counts(name, tag, serial):
    @query(name, reads_sql(f"SELECT n_reads, count(*) AS n_values FROM (SELECT count(*) AS n_reads FROM tagged GROUP BY {serial}) GROUP BY n_reads"))
    def counts(spark, sf_dir):
        tagged = tags.tag_reads(reads_from_orders(spark, sf_dir), mapping(spark))
        return stats.count_by(tagged, tag).groupBy("n_reads").agg(F.count("*").alias("n_values"))


_counts("isoform_counts", "xi", "chr32, strand, exon_text")
_counts("locus_counts", "xc", "chr32, strand, (left_ + right_) // 2 // 1000, len_text")
_counts("tss_counts", "x5", "chr32, strand, (CASE WHEN strand = '+' THEN left_ ELSE right_ END) // 200")
_counts("polya_counts", "x3", "chr32, strand, (CASE WHEN strand = '+' THEN right_ ELSE left_ END) // 200")


# D9
@query("md_rate", reads_sql("SELECT count(*) AS n_sampled, count(md) AS n_md, count(md) > 0 AND count(md) * 10 >= count(*) AS has_md FROM (SELECT md FROM reads WHERE flag & 4 = 0 ORDER BY ord LIMIT 100)"))
def md_rate(spark, sf_dir):
    return stats.md_rate(reads_from_orders(spark, sf_dir))


# What isn't tagged is there all the same
@query("unmapped_passthrough", reads_sql("SELECT reads.ord, reads.qname, tagged.ord IS NOT NULL AS tagged FROM reads LEFT JOIN tagged ON reads.ord = tagged.ord"))
def unmapped_passthrough(spark, sf_dir):
    return structured(spark, sf_dir).select("ord", "qname", "tagged")


# streaming: tags by window of event time
@query("tss_windows", """WITH e AS (SELECT date_trunc('hour', ts) AS window_start, CASE WHEN event_id % 2 = 1 THEN '-' ELSE '+' END AS strand, 1 + user_id % 19 AS c, 1 + user_id * 5000 + event_id % 700 AS pos,
  50 + event_id % 9 * 10 + 100 + event_id % 3 * 50 + 80 AS size FROM events),
b AS (SELECT window_start, c, strand, (CASE WHEN strand = '+' THEN pos ELSE pos + size - 1 END) // 200 AS bin FROM e)
SELECT window_start, n_reads, count(*) AS n_values FROM (SELECT window_start, count(*) AS n_reads FROM b GROUP BY window_start, c, strand, bin) GROUP BY ALL""")
def tss_windows(spark, sf_dir):
    tagged = tags.tag_reads(reads_from_events(table(spark, sf_dir, "events")), mapping(spark))
    return windowed_counts(tagged, "x5").groupBy("window_start", "n_reads").agg(F.count("*").alias("n_values"))


# Records out of text lines, short lines and headers among them
@query("sam_fields", reads_sql("SELECT ord, qname, CAST(flag AS INTEGER) AS flag, rname, pos, cigar, md FROM reads"))
def sam_fields(spark, sf_dir):
    r = reads_from_orders(spark, sf_dir)
    text = [F.col(c).cast("string") for c in ("qname", "flag", "rname", "pos")] + [F.lit("60"), F.col("cigar"), F.lit("*"), F.lit("0"), F.lit("0"), F.col("seq"), F.lit("*"), F.lit("NM:i:1"), F.concat(F.lit("MD:Z:"), F.col("md"))]
    lines = r.select("ord", F.concat_ws("\t", *text).alias("value"))
    lines = lines.union(r.select("ord", F.concat_ws("\t", "qname", "rname"))).union(r.select("ord", F.concat(F.lit("@CO\t"), F.concat_ws("\t", *text))))
    return parse_lines(lines).select("ord", "qname", "flag", "rname", "pos", "cigar", F.col("tags")["MD"]["value"].alias("md"))


# MD tags from the reference, for reads of one stretch on contigs of one repeated word
_MD_READS = "SELECT p_partkey AS ord, 'c' || (p_partkey % 3) AS rname, 1 + p_partkey * 7 % 3000 AS pos, 10 + p_partkey % 90 AS n FROM part"


@query("md_from_reference", f"""WITH r AS ({_MD_READS}),
b AS (SELECT ord, n, i, substr('ACGGT', CAST((pos - 1 + i + p) % 5 AS INTEGER) + 1, 1) AS ref, substr('ACGT', CAST(i % 4 AS INTEGER) + 1, 1) AS own
  FROM (SELECT *, CAST(substr(rname, 2) AS BIGINT) AS p, unnest(generate_series(0, n - 1)) AS i FROM r)),
m AS (SELECT *, lag(i, 1, -1) OVER (PARTITION BY ord ORDER BY i) AS before FROM b WHERE ref <> own)
SELECT r.ord, coalesce(string_agg((i - before - 1) || ref, '' ORDER BY i), '') || (r.n - 1 - coalesce(max(i), -1)) AS md FROM r LEFT JOIN m ON r.ord = m.ord GROUP BY r.ord, r.n""")
def md_from_reference(spark, sf_dir):
    k = F.col("p_partkey")
    n = 10 + k % 90
    reads = table(spark, sf_dir, "part").select(k.alias("ord"), F.lit(0).alias("flag"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("rname"), (1 + k * 7 % 3000).alias("pos"), F.concat(n.cast("string"), F.lit("M")).alias("cigar"), F.repeat(F.lit("ACGT"), F.lit(25)).substr(F.lit(1), n.cast("int")).alias("seq"))
    p = F.col("id")
    contigs = spark.range(3).select(F.concat(F.lit("c"), p.cast("string")).alias("name"), F.repeat(F.lit("ACGGT"), F.lit(700)).substr((p + 1).cast("int"), F.lit(3200)).alias("seq"))
    return reference.with_md(reads, contigs, 256).select("ord", "md")


# Substitutions without what both sides share
@query("normalized_substitutions", """WITH v AS (SELECT p_partkey AS ord, p_partkey * 3 AS spot, repeat('A', CAST(p_partkey % 3 AS INTEGER)) || ['C', 'CA', 'g'][p_partkey % 3 + 1] || repeat('G', CAST(p_partkey % 4 AS INTEGER)) AS r,
  repeat('A', CAST(p_partkey % 3 AS INTEGER)) || ['T', 'TT', 'GA', 'c'][p_partkey % 4 + 1] || repeat('G', CAST(p_partkey % 4 AS INTEGER)) AS a FROM part),
u AS (SELECT ord, spot, upper(r) AS r, upper(a) AS a FROM v WHERE upper(r) <> upper(a)),
t AS (SELECT ord, spot, left(r, CAST(length(r) - k AS BIGINT)) AS r, left(a, CAST(length(a) - k AS BIGINT)) AS a FROM (SELECT *, list_max([x FOR x IN generate_series(0, least(length(r), length(a))) IF right(r, x) = right(a, x)]) AS k FROM u)),
h AS (SELECT *, list_max([x FOR x IN generate_series(0, least(length(r), length(a))) IF left(r, x) = left(a, x)]) AS k FROM t)
SELECT ord, CAST(spot + k AS BIGINT) AS "start", substr(r, CAST(k AS BIGINT) + 1) AS ref, substr(a, CAST(k AS BIGINT) + 1) AS alt FROM h WHERE length(r) > k AND length(a) > k""")
def normalized_substitutions(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    lead, tail = F.repeat(F.lit("A"), (k % 3).cast("int")), F.repeat(F.lit("G"), (k % 4).cast("int"))
    v = table(spark, sf_dir, "part").select(k.alias("ord"), (k * 3).alias("at"), F.concat(lead, pick(["C", "CA", "g"]), tail).alias("r"), F.concat(lead, pick(["T", "TT", "GA", "c"]), tail).alias("a"))
    # The others have no identifier: with one side empty they are no substitutions, and asking for them is an error.
    both = lambda x, y: F.least(F.length(x), F.length(y))
    r, a = F.upper("r"), F.upper("a")
    shared = F.aggregate(F.sequence(F.lit(1), both(r, a)), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.right(r, i) == F.right(a, i)), i).otherwise(n))
    v = v.filter(r != a).withColumn("k", shared)
    left = lambda x: x.substr(F.lit(1), F.length(x) - F.col("k"))
    v = v.filter(~left(r).startswith(left(a)) & ~left(a).startswith(left(r)))
    return v.select("ord", normalize_substitution(F.col("at"), F.col("r"), F.col("a")).alias("n")).select("ord", "n.start", "n.ref", "n.alt")


# range join: 5' ends within 100 bases of a known site
@query("site_overlap", reads_sql(""", s AS (SELECT ord, rname, strand, CASE WHEN strand = '+' THEN left_ ELSE right_ END AS site FROM tagged),
k AS (SELECT rname, strand, site + ord % 300 - 150 AS at FROM s WHERE ord % 10 = 0)
SELECT ord, site, EXISTS (SELECT 1 FROM k WHERE k.rname = s.rname AND k.strand = s.strand AND k.at BETWEEN s.site - 100 AND s.site + 100) AS hit FROM s"""))
def site_overlap(spark, sf_dir):
    s = sites.ends(structured(spark, sf_dir), True).select("ord", "rname", "strand", "site")
    known = s.filter("ord % 10 = 0").select("rname", "strand", (F.col("site") + F.col("ord") % 300 - 150).alias("at"))
    return sites.near_sites(s, known).select("ord", "site", "hit")


# hashed values; golden vectors stand in the tests, as SQL has no SHA-512
@query("tags_hashed")
def tags_hashed(spark, sf_dir):
    return tags.tag_reads(reads_from_orders(spark, sf_dir), mapping(spark)).select("ord", "xi", "xb", "xs", "xt", "xc", "x5", "x3")


@query("vrs_ids")
def vrs_ids(spark, sf_dir):
    return known_reads(spark, sf_dir).select("ord", *tags.TAGS, "variant_emitted_count")


# Identifiers into the map of tags; one of the same name is replaced, the others stay
@query("tag_upsert", reads_sql("""SELECT r.ord, 'NM:i:' || (r.ord % 9) || coalesce(';XB:Z:' || chr8 || pm || '.' || lower(to_hex(left_)) || '.' || lower(to_hex(right_)), '')
  || ';XS:' || CASE WHEN t.ord IS NULL THEN 'A:+' ELSE 'Z:' || coalesce(chr8 || pm || '.' || junction_hex, 'single') END AS tags FROM reads r LEFT JOIN tagged t ON r.ord = t.ord"""))
def tag_upsert(spark, sf_dir):
    entry_ = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))
    own = F.create_map(F.lit("XS"), entry_("A", F.lit("+")), F.lit("NM"), entry_("i", F.col("ord") % 9))
    reads = reads_from_orders(spark, sf_dir).withColumn("tags", own)
    out = tags.set_tags(tags.with_serials(tags.with_structure(reads, mapping(spark))), ("xb", "xs"))
    return out.select("ord", F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"])), ";").alias("tags"))


# E5: metadata of merged mappings, in the order of the files
@query("merged_metadata", """SELECT s_nationkey, max(total) AS total_sequences, bool_and(coalesce(masked, true)) AS ambiguous_bases_masked, string_agg('g' || s_suppkey, ',' ORDER BY s_suppkey) AS source_genomes, string_agg('f' || (s_suppkey % 7), ',' ORDER BY s_suppkey) AS source_files
FROM (SELECT s_nationkey, s_suppkey, CAST(s_suppkey * 3 % 11 AS INTEGER) AS total, CASE s_suppkey % 4 WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS masked FROM supplier) GROUP BY s_nationkey""")
def merged_metadata(spark, sf_dir):
    k = F.col("s_suppkey")
    masked = F.when(k % 4 == 1, False).when(k % 4 == 2, None).otherwise(True)
    files = table(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("g"), k.cast("string")).alias("genome"), (k * 3 % 11).cast("int").alias("total_sequences"), masked.alias("ambiguous_bases_masked"), F.concat(F.lit("f"), (k % 7).cast("string")).alias("file"), k.alias("file_ord"))
    out = refget.merged_metadata(files, "s_nationkey")
    return out.select("s_nationkey", "total_sequences", "ambiguous_bases_masked", F.array_join("source_genomes", ",").alias("source_genomes"), F.array_join("source_files", ",").alias("source_files"))


# exons that come in any order
@query("sorted_exons", """SELECT l_orderkey AS ord, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i, CAST(l_partkey AS BIGINT) AS "start" FROM lineitem""")
def sorted_exons(spark, sf_dir):
    e = F.struct(F.col("l_partkey").cast("long").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.collect_list(e).alias("exons"))
    return exploded(rows, cigar.sort_exons(F.col("exons")), "ord").select("ord", F.col("k").alias("i"), "x.start")


# Secondary and supplementary alignments are left untagged on request
@query("primary_reads", reads_sql("SELECT reads.ord, tagged.ord IS NOT NULL AND reads.ord % 3 = 0 AS tagged FROM reads LEFT JOIN tagged ON reads.ord = tagged.ord"))
def primary_reads(spark, sf_dir):
    k = F.col("ord")
    reads = reads_from_orders(spark, sf_dir).withColumn("flag", F.col("flag").bitwiseOR(F.when(k % 3 == 1, 256).when(k % 3 == 2, 2048).otherwise(0)))
    return tags.with_structure(reads, mapping(spark), TagConfig(primary_only=True)).select("ord", "tagged")


# A4: reads as text lines
@query("sam_lines", reads_sql("""SELECT ord, concat_ws(chr(9), qname, CAST(flag AS BIGINT), rname, pos, '0', cigar, '*', '0', '0', substr(repeat('ACGT', CAST(size // 4 + 1 AS INTEGER)), 1, CAST(size AS INTEGER)), '*', 'MD:Z:' || md) AS line FROM reads"""))
def sam_lines(spark, sf_dir):
    md_ = F.when(F.col("md").isNotNull(), F.create_map(F.lit("MD"), F.struct(F.lit("Z").alias("type"), F.col("md").alias("value"))))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("mapq", "int"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("qual", "string"))]
    reads = reads_from_orders(spark, sf_dir).select("*", *none, md_.alias("tags"))
    return reads.select("ord", to_line(reads.columns).alias("line"))


# H3: other bin sizes than the usual ones
_SIZES = TagConfig(position_quantum=5_000, span_quantum=500, exon_quantum=200, xc_bin_size=25, xc_position_quantum=2_000, x5x3_bin_size=50)


@query("other_bins", reads_sql("""SELECT ord, chr32 || '|' || strand || '|' || (CAST(round_even(CAST((left_ + right_) // 2 AS DOUBLE) / 5000, 0) AS BIGINT) * 5000) || '|' || (CAST(round_even(CAST(exon_total AS DOUBLE) / 200, 0) AS BIGINT) * 200) || '|' || (CAST(round_even(CAST(right_ - left_ AS DOUBLE) / 500, 0) AS BIGINT) * 500) || coalesce('|' || junction_text, '') AS xt_serial,
  chr32 || '|' || strand || '|' || ((left_ + right_) // 2 // 2000) || '|' || len_text AS xc_serial, chr32 || '|' || strand || '|' || ((CASE WHEN strand = '+' THEN left_ ELSE right_ END) // 50) AS x5_serial FROM tagged""", 25))
def other_bins(spark, sf_dir):
    return serials(spark, sf_dir, _SIZES).select("ord", "xt_serial", "xc_serial", "x5_serial")


QUERIES |= vectors.QUERIES
SQL |= vectors.SQL
