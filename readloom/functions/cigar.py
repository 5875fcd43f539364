"""CIGAR operations, exons and their metrics as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.folds import appended, either, emitting

EXONS = "array<struct<start:bigint,end:bigint>>"


def operations(cigar: Column) -> Column:
    """array<struct<n, o>>; anything that is no operation is passed over; ``*``, empty and null have none."""
    found = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    parsed = F.transform(found, lambda x: F.struct(x.substr(F.lit(1), F.length(x) - 1).cast("long").alias("n"), F.substring(x, -1, 1).alias("o")))
    return F.coalesce(parsed, F.array().cast("array<struct<n:bigint,o:string>>"))


def has_exons(cigar: Column) -> Column:
    """Whether ``exons`` finds any: from the text alone, so that a filter on it costs no walk and goes down to the scan."""
    return cigar.rlike("[0-9]N|[1-9][0-9]*[M=XD]")


def exons(pos: Column, ops: Column) -> Column:
    """Exons (1-based, closed) in the order of the reference: N ends one, the next M, = or X opens one."""
    pos = pos.cast("long")
    begin = {"cur": pos, "at": pos, "open": F.lit(True)}

    def closed(a: Column) -> Column:
        return appended(a["out"], F.struct(a["at"].alias("start"), (a["cur"] - 1).alias("end")))

    def step(a: Column, x: Column) -> Column:
        # Folds are interpreted, so the frequent operations come first, and each makes one struct.
        o, to = x["o"], (a["cur"] + x["n"]).alias("cur")
        match = F.struct(to, either(a["open"], a["at"], a["cur"]).alias("at"), F.lit(True).alias("open"), a["out"].alias("out"))
        skip = F.struct(to, a["at"].alias("at"), F.lit(False).alias("open"), either(a["open"], closed(a), a["out"]).alias("out"))
        gone = F.struct(to, a["at"].alias("at"), a["open"].alias("open"), a["out"].alias("out"))
        return either(o == "M", match, either(o == "N", skip, either(o.isin("=", "X"), match, either(o == "D", gone, a))))

    return F.when(ops.isNotNull(), emitting(ops, begin, EXONS, step, lambda a: F.when(a["open"] & (a["at"] < a["cur"]), closed(a)).otherwise(a["out"])))


def sort_exons(value: Column) -> Column:
    """By start only, stable as far as array_sort is; for exons that come from elsewhere."""
    return F.array_sort(value, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def first_start(value: Column) -> Column:
    return F.get(value, F.lit(0))["start"]


def last_end(value: Column) -> Column:
    return F.try_element_at(value, F.lit(-1))["end"]


def total_length(value: Column) -> Column:
    return F.aggregate(value, F.lit(0).cast("long"), lambda a, e: a + (e["end"] - e["start"] + 1))


def junctions(value: Column) -> Column:
    """end, start, end, start, … of the introns between exons; empty for fewer than two."""
    pairs = F.transform(F.slice(value, 2, F.greatest(F.size(value) - 1, F.lit(0))), lambda e, i: F.array(F.get(value, i)["end"], e["start"]))
    return F.when(F.size(value) > 1, F.flatten(pairs)).otherwise(F.array().cast("array<bigint>"))


def junction_texts(value: Column, text: Callable[[Column], Column], sep: str) -> Column:
    """For each intron the texts of its end and start, joined; empty for fewer than two exons."""
    return F.transform(F.slice(value, 2, F.greatest(F.size(value) - 1, F.lit(0))), lambda e, i: F.concat(text(F.get(value, i)["end"]), F.lit(sep), text(e["start"])))


def upper_hex(value: Column) -> Column:
    return either(value < 0, F.concat(F.lit("-"), F.hex(-value)), F.hex(value))


def to_hex(value: Column) -> Column:
    return F.lower(upper_hex(value))
