"""From reversible tags back to coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import cigar
from readloom.functions.folds import either, let
from readloom.operators.joins import apart

#: Names of a mapping that may be broadcast.
BROADCAST_NAMES = 200_000
_HEX = "^-?[0-9a-f]+$"
#: The numbers of a whole tag, after chromosome and strand: each of them then is one of _HEX.
_ALL_HEX = r"^-?[0-9a-f]+(\.-?[0-9a-f]+)*+$"


def from_hex(value: Column) -> Column:
    """A whole number; an error for anything that isn't hexadecimal."""
    wrong = F.raise_error(F.concat(F.lit("not hexadecimal: "), F.coalesce(value, F.lit("null")))).cast("bigint")
    return F.when(~F.coalesce(value.rlike(_HEX), F.lit(False)), wrong).otherwise(_plain_hex(value))


def _plain_hex(value: Column) -> Column:
    """``from_hex`` of what is known to be hexadecimal."""
    size = lambda x: F.conv(x, 16, 10).cast("bigint")
    return either(value.startswith("-"), -size(F.substring(value, 2, 1 << 30)), size(value))


def numbers(tag: Column) -> Column:
    """The numbers of a tag, which is looked at once; where one is wrong, they are taken one by one, for the error."""
    rest = F.substring(tag, 11, 1 << 30)
    return let(rest, lambda text: let(F.split(text, r"\."), lambda parts: either(text.rlike(_ALL_HEX), F.transform(parts, _plain_hex), F.transform(parts, from_hex))))


def is_single(xs: Column) -> Column:
    return xs.isNull() | xs.isin("", "None", "single")


def is_single_text(xs: str | None) -> bool:
    return xs in (None, "", "None", "single")


def boundary(xb: Column) -> Column:
    """struct(chr8, strand, left, right)."""
    at = lambda part, k: from_hex(F.get(part, F.lit(k)))
    ends = let(F.split(F.substring(xb, 11, 1 << 30), r"\."), lambda part: F.struct(F.substring(xb, 1, 8).alias("chr8"), _strand(xb).alias("strand"), at(part, 0).alias("left"), at(part, 1).alias("right")))
    return F.when(xb.isNotNull(), ends)


def _strand(tag: Column) -> Column:
    return F.when(F.substring(tag, 9, 1) == "p", "+").otherwise("-")


def splice(xs: Column) -> Column:
    """struct(chr8, strand, coords); null for a read of one exon."""
    return F.when(~is_single(xs), F.struct(F.substring(xs, 1, 8).alias("chr8"), _strand(xs).alias("strand"), numbers(xs).alias("coords")))


def exons(bounds: Column, spliced: Column) -> Column:
    """Exons from decoded tags."""
    c = spliced["coords"]
    last = F.shiftright(F.size(c) + 1, 1)
    one = F.array(F.struct(bounds["left"].alias("start"), bounds["right"].alias("end")))
    # An odd coordinate too many leaves the last exon without a start.
    start, end = lambda i: either(i == 0, bounds["left"], F.get(c, i * 2 - 1)), lambda i: either(i == last, bounds["right"], F.get(c, i * 2))
    return F.when(spliced.isNull(), one).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(start(i).alias("start"), end(i).alias("end"))))


def chromosome_names(mapping: DataFrame) -> DataFrame:
    """chr8 and the names (sorted) whose digest starts with it."""
    bare = F.regexp_replace("refget_id", "^ga4gh:", "")
    return mapping.filter(bare.startswith("SQ.")).groupBy(F.substring(bare, 4, 8).alias("chr8")).agg(F.sort_array(F.collect_list("name")).alias("names"))


def decode_tags(rows: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """rows (xb, xs) with chr8, strand, left, right, junction_coords, n_junctions, exons, total_exon_length, span, intron_length,
    tags_consistent (both tags name one chromosome and strand) and chr_names."""
    out = rows.withColumn("__b", boundary(F.col("xb"))).withColumn("__s", splice(F.col("xs")))
    out = out.withColumn("exons", exons(F.col("__b"), F.col("__s"))).withColumns({
        "chr8": F.col("__b")["chr8"], "strand": F.col("__b")["strand"], "left": F.col("__b")["left"], "right": F.col("__b")["right"],
        "junction_coords": F.coalesce(F.col("__s")["coords"], F.array().cast("array<bigint>")),
        "total_exon_length": cigar.total_length(F.col("exons")), "span": F.col("__b")["right"] - F.col("__b")["left"] + 1,
        "tags_consistent": F.col("__s").isNull() | ((F.col("__s")["chr8"] == F.col("__b")["chr8"]) & (F.col("__s")["strand"] == F.col("__b")["strand"])),
    })
    out = out.withColumns({"n_junctions": (F.size("junction_coords") / 2).cast("long"), "intron_length": F.when(F.size("exons") > 1, F.col("span") - F.col("total_exon_length")), "exon_lengths": F.transform("exons", lambda e: e["end"] - e["start"] + 1)}).drop("__b", "__s")
    return _named(out, mapping)


def decode_splice(rows: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """rows (xs) with chr8, strand, junction_coords, n_junctions and chr_names, for tags that come without their boundary; null for a read of one exon."""
    out = rows.withColumn("__s", splice(F.col("xs")))
    out = out.withColumns({"chr8": F.col("__s")["chr8"], "strand": F.col("__s")["strand"], "junction_coords": F.col("__s")["coords"]}).drop("__s")
    return _named(out.withColumn("n_junctions", F.when(F.col("chr8").isNotNull(), (F.size("junction_coords") / 2).cast("long"))), mapping)


def _named(out: DataFrame, mapping: DataFrame | None) -> DataFrame:
    unknown = F.array(F.concat(F.lit("<chr_hash:"), F.col("chr8"), F.lit(">")))
    if mapping is None:
        return out.withColumn("chr_names", unknown)
    # As many rows as the mapping has sequences: sent to the rows where that is few, else joined so that AQE can deal out a frequent chromosome.
    names = chromosome_names(mapping).withColumnRenamed("chr8", "__chr8")
    names = F.broadcast(names) if mapping.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else apart(names, "__chr8")
    return out.join(names, F.col("chr8") == F.col("__chr8"), "left").withColumn("chr_names", F.coalesce("names", unknown)).drop("names", "__chr8")
