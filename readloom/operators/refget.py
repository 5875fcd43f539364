"""Tables of sequence names and digests: made from sequences, widened by naming variants, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.hashing import ambiguous_count, refget_id


def from_sequences(contigs: DataFrame, keep_ambiguous: bool = False, validate: bool = True) -> DataFrame:
    """(name, refget_id, length, n_ambiguous, ord) of contigs (name, seq, ord); of equal names the last stays."""
    from readloom.functions.hashing import mask_ambiguous, sha512t24u

    made = refget_id(F.col("seq"), keep_ambiguous) if validate else F.concat(F.lit("SQ."), sha512t24u(mask_ambiguous(F.col("seq"), keep_ambiguous)))
    rows = contigs.filter(F.length("seq") > 0).select("name", "ord", made.alias("refget_id"), F.length("seq").cast("long").alias("length"), ambiguous_count(F.regexp_replace("seq", r"\s", "")).alias("n_ambiguous"))
    return rows.groupBy("name").agg(F.max_by(F.struct("refget_id", "length", "n_ambiguous"), "ord").alias("r"), F.min("ord").alias("ord")).select("name", "r.*", "ord")


def name_variants(name: Column) -> Column:
    """The name itself first, then its spellings with and without chr."""
    rest = F.substring(name, 4, 1 << 30)
    with_prefix = lambda x: [F.concat(F.lit(p), x) for p in ("chr", "Chr", "CHR")]
    # A letter or digit of any script makes a name a bare one; so does no sign at all but those.
    made = F.when(F.lower(name).startswith("chr"), F.array(name, rest, *with_prefix(rest))).when(name.rlike(r"^[\p{L}\p{Nd}\p{Nl}\p{No}]+$"), F.array(name, *with_prefix(name))).otherwise(F.array(name))
    return F.array_distinct(made)


def with_variants(mapping: DataFrame) -> DataFrame:
    """(name, refget_id) for all spellings of mapping (name, refget_id, ord); where they meet, the later entry counts."""
    rows = mapping.select("ord", "refget_id", F.posexplode(name_variants(F.col("name"))).alias("k", "name"))
    return rows.groupBy("name").agg(F.max_by("refget_id", F.struct("ord", "k")).alias("refget_id"))


def is_bogus(name: Column) -> Column:
    """All digits and over 30, bare or behind chr: a cut-off accession, no chromosome."""
    digits = F.regexp_replace(name, "^(chr|Chr|CHR)", "")
    return digits.rlike("^[0-9]+$") & ((F.length(F.regexp_replace(digits, "^0+", "")) > 2) | (digits.try_cast("bigint") > 30))


def conflicts(mappings: DataFrame) -> DataFrame:
    """Names of rows (name, refget_id, file_ord, key_ord) with more than one digest: what stays, and the others."""
    g = mappings.groupBy("name").agg(F.count_distinct("refget_id").alias("n_ids"), F.min_by("refget_id", F.struct("file_ord", "key_ord")).alias("kept"), F.sort_array(F.collect_set("refget_id")).alias("ids"))
    return g.filter("n_ids > 1").select("name", "n_ids", "kept", F.array_except("ids", F.array("kept")).alias("dropped"))


def merge(mappings: DataFrame) -> DataFrame:
    """One mapping (name, refget_id) of rows (name, refget_id, file_ord, key_ord).

    A name's first file counts. Bogus names go. All names of a digest get their spellings; where those of two digests
    meet, the digest seen later counts."""
    first = mappings.groupBy("name").agg(F.min(F.struct("file_ord", "key_ord", "refget_id")).alias("r")).select("name", "r.*").filter(~is_bogus(F.col("name")))
    seen = first.groupBy("refget_id").agg(F.min(F.struct("file_ord", "key_ord")).alias("seen"))
    rows = first.join(seen, "refget_id").select("refget_id", "seen", F.explode(name_variants(F.col("name"))).alias("name"))
    return rows.groupBy("name").agg(F.max_by("refget_id", "seen").alias("refget_id"))


def merged_metadata(metadata: DataFrame, *by: str) -> DataFrame:
    """One row (for each value of ``by``) of rows (genome, generated, total_sequences, total_mappings, ambiguous_bases_masked, file, file_ord)."""
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("file_ord", c))), lambda x: x[c])
    return metadata.groupBy(*by).agg(F.max("total_sequences").alias("total_sequences"), F.bool_and(F.coalesce("ambiguous_bases_masked", F.lit(True))).alias("ambiguous_bases_masked"), in_order("genome").alias("source_genomes"), in_order("file").alias("source_files"))
