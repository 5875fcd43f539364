"""Folds over arrays that give out elements as they go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one inner fold takes.
BLOCK = 64


def emitting(items: Column, state: dict[str, Column], out: str, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column], block: int = BLOCK) -> Column:
    """What a fold of ``step`` over ``items`` has put into its field ``out``, an array of the type ``out``, in the end.

    A fold's step gets a struct of the state's fields and ``out`` and gives the next one, with ``out`` grown at its end.
    As every growth copies the array, a plain fold would take the square of its length. So the items are folded in
    blocks, each with an ``out`` of its own, and the blocks' results are put together once: the copies cost ``block`` an item."""
    none = F.array().cast(out)
    fields = list(state)
    begin = F.struct(*[v.alias(k) for k, v in state.items()], none.alias("out"))

    def on(a: Column, part: Column) -> Column:
        again = F.struct(*[a["last"][k].alias(k) for k in fields], none.alias("out"))
        return F.struct(F.aggregate(part, again, step).alias("last"), F.concat(a["done"], F.array(a["last"]["out"])).alias("done"))

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, block))
        start = F.struct(begin.alias("last"), F.array().cast(f"array<{out}>").alias("done"))
        many = F.aggregate(blocks, start, on, lambda a: F.flatten(F.concat(a["done"], F.array(finish(a["last"])))))
        return F.when(F.size(xs) <= block, F.aggregate(xs, begin, step, finish)).otherwise(many)

    return let(items, whole)


def appended(items: Column, item: Column) -> Column:
    """``items`` with one more at its end; ``concat`` makes a second array and a lazy list of both first."""
    return F.array_append(items, item)


def either(condition: Column, yes: Column, no: Column) -> Column:
    """``when``, ``otherwise`` in the steps of folds: an interpreted CASE WHEN walks a list for each of its branches."""
    return F.call_function("if", condition, yes, no)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
