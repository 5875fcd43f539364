"""The tagger: eight identifiers for each read, as projections over one broadcastable lookup. No shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.config import TagConfig
from readloom.functions import bins, cigar, md
from readloom.functions.hashing import ACCESSION, allele_id, sha512t24u
from readloom.operators.joins import apart

TAGS = ("xi", "xb", "xs", "xt", "xc", "x5", "x3", "xv")
#: A mapping of at most so many names is broadcast (some 100 bytes each); a larger one is joined by shuffle.
BROADCAST_NAMES = 200_000


def fallback_hash(name: Column) -> Column:
    """For a sequence without a known digest: the digest of its name in upper case, without any CHR."""
    return sha512t24u(F.replace(F.upper(name), F.lit("CHR"), F.lit("")))


def with_chromosome(reads: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """reads with refget_id (null if unknown), chr32 and chr8. The digests of known names are computed on the mapping's side."""
    if mapping is None:
        out = reads.withColumn("refget_id", F.lit(None).cast("string"))
        return out.withColumn("chr32", F.substring(fallback_hash(F.col("rname")), 1, 32)).withColumn("chr8", F.substring("chr32", 1, 8))
    bare = F.regexp_replace("refget_id", "^ga4gh:", "")
    side = mapping.select(F.col("name").alias("__name"), bare.alias("refget_id"), F.when(bare.startswith("SQ."), F.substring(F.split(bare, "[.]")[1], 1, 32)).alias("__hash")).dropDuplicates(["__name"])
    # A large mapping is joined so that AQE can deal out the reads of a frequent sequence.
    side = F.broadcast(side) if mapping.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else apart(side, "__name")
    out = reads.drop("refget_id").join(side, F.col("rname") == F.col("__name"), "left")
    return out.withColumn("chr32", F.coalesce("__hash", F.substring(fallback_hash(F.col("rname")), 1, 32))).withColumn("chr8", F.substring("chr32", 1, 8)).drop("__name", "__hash")


def strand(flag: Column) -> Column:
    return F.when(flag.bitwiseAND(16) != 0, "-").otherwise("+")


def is_mapped(flag: Column, text: Column) -> Column:
    return (flag.bitwiseAND(4) == 0) & text.isNotNull() & (text != "*") & (text != "")


def joined(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def xi_serial() -> Column:
    return joined(F.col("chr32"), F.col("strand"), F.transform("exons", lambda e: F.concat(e["start"].cast("string"), F.lit(":"), e["end"].cast("string"))))


def sign() -> Column:
    return F.when(F.col("strand") == "+", "p").otherwise("m")


def xb_value() -> Column:
    e = F.col("exons")
    return F.concat(F.col("chr8"), sign(), F.lit("."), cigar.to_hex(cigar.first_start(e)), F.lit("."), cigar.to_hex(cigar.last_end(e)))


def xs_value() -> Column:
    """Null for a read of one exon."""
    j = cigar.junction_texts(F.col("exons"), cigar.upper_hex, ".")
    return F.when(F.size("exons") > 1, F.concat(F.col("chr8"), sign(), F.lit("."), F.lower(F.array_join(j, "."))))


def xt_serial(c: TagConfig) -> Column:
    e = F.col("exons")
    start, end = cigar.first_start(e), cigar.last_end(e)
    return joined(
        F.col("chr32"), F.col("strand"),
        bins.cluster_position(start, end, F.col("strand"), c.clustermode, c.position_quantum).cast("string"),
        bins.nearest(cigar.total_length(e), c.exon_quantum).cast("string"),
        bins.nearest(end - start, c.span_quantum).cast("string"),
        cigar.junction_texts(e, lambda x: x.cast("string"), "|"),
    )


def xc_serial(c: TagConfig) -> Column:
    e = F.col("exons")
    middle = bins.floor_div(bins.floor_div(cigar.first_start(e) + cigar.last_end(e), 2), c.xc_position_quantum).cast("string")
    lengths = F.transform(e, lambda x: bins.floor_div(x["end"] - x["start"] + 1, c.xc_bin_size).cast("string"))
    return joined(F.col("chr32"), F.col("strand"), middle, *[] if c.xc_midpoint_only else [lengths])


def end_serial(c: TagConfig, five: bool) -> Column:
    e = F.col("exons")
    at = F.when((F.col("strand") == "+") == F.lit(five), cigar.first_start(e)).otherwise(cigar.last_end(e))
    return joined(F.col("chr32"), F.col("strand"), bins.floor_div(at, c.x5x3_bin_size).cast("string"))


def with_structure(reads: DataFrame, mapping: DataFrame | None = None, config: TagConfig = TagConfig()) -> DataFrame:
    """reads with ops, exons, strand, the chromosome's columns and ``tagged``; every read stays, in whatever order it came."""
    may = is_mapped(F.col("flag"), F.col("cigar")) & F.col("pos").isNotNull()
    if config.primary_only:
        may &= F.col("flag").bitwiseAND(0x900) == 0
    out = with_chromosome(reads, mapping).withColumn("strand", strand(F.col("flag"))).withColumn("ops", F.when(may, cigar.operations(F.col("cigar"))))
    out = out.withColumn("exons", F.when(F.size("ops") > 0, cigar.exons(F.col("pos"), F.col("ops"))))
    return out.withColumn("tagged", F.coalesce(may & cigar.has_exons(F.col("cigar")), F.lit(False)))


def with_serials(structured: DataFrame, config: TagConfig = TagConfig()) -> DataFrame:
    """The texts that are hashed, and the reversible tags; null for reads that are not tagged."""
    own = F.col("tagged")
    values = {"xi_serial": xi_serial(), "xb": xb_value(), "xs": F.coalesce(xs_value(), F.lit("single")), "xt_serial": xt_serial(config), "xc_serial": xc_serial(config), "x5_serial": end_serial(config, True), "x3_serial": end_serial(config, False)}
    return structured.withColumns({k: F.when(own, v) for k, v in values.items()})


def with_variants(structured: DataFrame) -> DataFrame:
    """xv, the candidates and their counts. A read with a substitution on a sequence without an accession is an error."""
    tag = "md" if "md" in structured.columns else None
    text = F.col(tag) if tag else F.element_at(F.col("tags"), "MD")["value"]
    out = structured.withColumn("variants", F.when(F.col("tagged"), md.candidates(F.col("ops"), F.col("pos"), F.col("seq"), text)))
    known = F.col("refget_id").rlike(ACCESSION)
    wrong = F.raise_error(F.concat(F.lit("no refget accession for "), F.coalesce("rname", F.lit("null")))).cast("array<string>")
    snv = F.filter("variants", lambda v: (F.length(v["ref"]) == 1) & (F.length(v["alt"]) == 1))
    ids = F.array_sort(F.array_distinct(F.transform(snv, lambda v: allele_id(F.col("refget_id"), v["start"], v["ref"], v["alt"]))))
    out = out.withColumn("__ids", F.when(F.coalesce(F.size("variants"), F.lit(0)) <= 0, F.array().cast("array<string>")).when(F.col("refget_id").isNull(), wrong).when(known, ids).otherwise(F.array().cast("array<string>")))
    return out.withColumns({
        "xv": F.when(F.size("__ids") > 0, F.array_join("__ids", ",")),
        "variant_candidate_count": F.greatest(F.coalesce(F.size("variants"), F.lit(0)), F.lit(0)).cast("long"),
        "variant_emitted_count": F.size("__ids").cast("long"),
    }).drop("__ids")


def tag_reads(reads: DataFrame, mapping: DataFrame | None = None, config: TagConfig = TagConfig(), variants: bool = False) -> DataFrame:
    """Every read of ``reads`` (flag, rname, pos, cigar, and for variants seq and md or tags) with its identifiers.

    Works on batch and streaming frames alike: the plan is a projection and one left lookup."""
    out = with_serials(with_structure(reads, mapping, config), config)
    for tag in ("xi", "xt", "xc", "x5", "x3"):
        out = out.withColumn(tag, sha512t24u(F.col(f"{tag}_serial")))
    return with_variants(out) if variants else out


def set_tags(tagged: DataFrame, names: tuple[str, ...] = TAGS) -> DataFrame:
    """Writes the identifiers into the map of SAM tags; a tag of the same name is replaced, one without a value stays as it was."""
    there = [n for n in names if n in tagged.columns]
    new = F.filter(F.array(*[F.struct(F.lit(n.upper()).alias("k"), F.struct(F.lit("Z").alias("type"), F.col(n).alias("value")).alias("v")) for n in there]), lambda x: x["v"]["value"].isNotNull())
    made = F.map_from_entries(new)
    kind = "map<string,struct<type:string,value:string>>"
    old = F.coalesce(F.col("tags"), F.create_map().cast(kind)) if "tags" in tagged.columns else F.create_map().cast(kind)
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(made), k), F.lit(False)))
    return tagged.withColumn("tags", F.map_concat(kept, made.cast(kind)))


def variant_policy(reads: DataFrame, mapping_masked: bool | None, no_variants: bool = False, has_genome: bool = False, has_mapping: bool = True) -> bool:
    """Whether variants are called: never with ``no_variants``; with a genome, or if the reads' MD tags are frequent.

    Then a mapping is needed, and one whose sequences were not masked (an unknown state counts as masked)."""
    from readloom.operators.stats import md_rate

    if no_variants or not (has_genome or md_rate(reads).first()["has_md"]):
        return False
    if not has_mapping:
        raise ValueError("variants need a refget mapping, or no_variants")
    if mapping_masked is not False:
        raise ValueError("variants need a mapping of unmasked sequences (keep_ambiguous), or no_variants")
    return True
