"""MD tags from the reference: what stands where a read differs, computed without leaving the JVM.

Contigs are cut into tiles. Each aligned or deleted stretch of a read looks up the tiles that it touches, so neither a
contig nor a genome is ever sent whole to a task; one shuffle brings stretches and tiles together, one puts a read's
stretches together again. Reads over a hot locus meet in one tile: AQE splits such a join. Only (ord, stretches) goes through the first shuffle, not the reads' other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import cigar, md

TILE = 1 << 14


def tiles(contigs: DataFrame, size: int = TILE) -> DataFrame:
    """(name, tile, bases) of contigs (name, seq), in upper case."""
    starts = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size))
    rows = contigs.filter(F.length("seq") > 0).select("name", "seq", F.explode(starts).alias("tile"))
    return rows.select("name", "tile", F.upper(F.col("seq").substr((F.col("tile") * size + 1).cast("int"), F.lit(size))).alias("bases"))


def _stretches(reads: DataFrame, size: int) -> DataFrame:
    """(ord, rname, k, o, seg, tile, at, n, bases of the read): a row for each tile that a stretch touches."""
    segments = F.transform(md.segments(cigar.operations(F.col("cigar")), F.col("pos")), lambda g, k: F.struct(k.alias("k"), g["o"].alias("o"), g["n"].alias("n"), g["r"].alias("r"), g["q"].alias("q")))
    rows = reads.select("ord", "rname", "seq", F.explode_outer(F.filter(segments, lambda g: g["o"].isin("M", "=", "X", "D") & (g["n"] > 0))).alias("g"))
    first, last = F.floor(F.greatest(F.col("g.r"), F.lit(0)) / size), F.floor((F.col("g.r") + F.col("g.n") - 1) / size)
    rows = rows.filter(F.col("g.r") + F.col("g.n") > 0).select("ord", "rname", "seq", "g", F.explode(F.sequence(first, last)).alias("tile"))
    left, right = F.greatest("g.r", F.col("tile") * size), F.least(F.col("g.r") + F.col("g.n"), (F.col("tile") + 1) * size)
    own = F.when(F.col("g.o") != "D", F.upper(F.col("seq").substr((F.col("g.q") + left - F.col("g.r") + 1).cast("int"), (right - left).cast("int"))))
    return rows.select("ord", "rname", F.col("g.k").alias("k"), F.col("g.o").alias("o"), "tile", (left - F.col("tile") * size).alias("at"), (right - left).alias("n"), own.alias("read"))


def _text(parts: Column) -> Column:
    """The MD text of stretches in order, each with o, read and ref; a deletion keeps its mark over the edge of a tile."""
    begin = F.struct(F.lit(0).cast("long").alias("same"), F.lit("").alias("out"), F.lit(-1).alias("deleted"))

    def step(a: Column, p: Column) -> Column:
        goes_on = (p["o"] == "D") & (a["deleted"] == p["k"])
        gone = F.struct(F.lit(0).cast("long").alias("same"), F.when(goes_on, F.concat(a["out"], p["ref"])).otherwise(F.concat(a["out"], a["same"].cast("string"), F.lit("^"), p["ref"])).alias("out"), p["k"].cast("int").alias("deleted"))
        compared = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.least(F.length(p["ref"]), F.length(p["read"])), F.lit(1))),
            F.struct(a["same"].alias("same"), a["out"].alias("out"), F.lit(-1).alias("deleted")),
            lambda b, i: F.when(
                ((p["read"].substr(i, F.lit(1)) == p["ref"].substr(i, F.lit(1))) & (p["ref"].substr(i, F.lit(1)) != "N")) | (p["read"].substr(i, F.lit(1)) == "="),
                F.struct((b["same"] + 1).alias("same"), b["out"].alias("out"), F.lit(-1).alias("deleted")),
            ).otherwise(F.struct(F.lit(0).cast("long").alias("same"), F.concat(b["out"], b["same"].cast("string"), p["ref"].substr(i, F.lit(1))).alias("out"), F.lit(-1).alias("deleted"))),
        )
        return F.when(F.length(p["ref"]) == 0, a).when(p["o"] == "D", gone).otherwise(compared)

    return F.aggregate(parts, begin, step, lambda a: F.concat(a["out"], a["same"].cast("string")))


def with_md(reads: DataFrame, contigs: DataFrame, size: int = TILE) -> DataFrame:
    """reads (ord, flag, rname, pos, cigar, seq, …; ord is unique) with a column ``md`` made from contigs (name, seq).

    Null for reads that are not mapped, have no SEQ or lie on no contig. What reaches past a contig's end is left out.
    A column ``md`` that is there is replaced. Of contigs of one name the last counts, as in a mapping."""
    if "ord" in contigs.columns:
        contigs = contigs.groupBy("name").agg(F.max_by("seq", "ord").alias("seq"))
    mapped = reads.filter((F.col("flag").bitwiseAND(4) == 0) & ~F.coalesce("seq", F.lit("*")).isin("", "*") & ~F.coalesce("cigar", F.lit("*")).isin("", "*"))
    sides = _stretches(mapped, size).join(tiles(contigs, size).withColumnRenamed("name", "rname"), ["rname", "tile"])
    sides = sides.select("ord", "k", "tile", "o", "read", F.col("bases").substr((F.col("at") + 1).cast("int"), F.col("n").cast("int")).alias("ref"))
    texts = sides.groupBy("ord").agg(_text(F.sort_array(F.collect_list(F.struct("k", "tile", "o", "read", "ref")))).alias("__md"))
    return reads.drop("md").join(texts.withColumnRenamed("ord", "__ord"), F.col("ord") == F.col("__ord"), "left").withColumnRenamed("__md", "md").drop("__ord")
