"""Bins of coordinates; all floor-exact, for negative values too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(value: Column, size: int) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(size)), F.lit(size))


def down(value: Column, size: int) -> Column:
    return value - F.pmod(value, F.lit(size))


def up(value: Column, size: int) -> Column:
    return down(value + (size - 1), size)


def nearest(value: Column, size: int) -> Column:
    """The nearest multiple; half-way values go to the even one."""
    return F.rint(value / F.lit(size)).cast("long") * F.lit(size)


def cluster_position(start: Column, end: Column, strand: Column, mode: str, size: int) -> Column:
    if mode == "5prime":
        return F.when(strand == "+", down(start, size)).otherwise(up(end, size))
    if mode == "3prime":
        return F.when(strand == "+", up(end, size)).otherwise(down(start, size))
    return nearest(((start + end) / 2).cast("long"), size)
