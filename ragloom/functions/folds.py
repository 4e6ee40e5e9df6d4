"""Greedy folds over an ordered array inside one row: each gives one number an element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A fold copies what it has gathered at every step, so long arrays are folded in blocks of so many elements.
BLOCK = 64


def _folded(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """One number an element: ``step`` takes the state (bin, n, size) and an element and gives the next state, whose bin is the number.

    The state goes on from block to block; the numbers are gathered by block.
    """
    names = ["bin", "n", "size"]
    state = lambda acc: F.struct(*[acc[n].alias(n) for n in names])
    none = F.array().cast("array<int>")

    def element(acc: Column, x: Column) -> Column:
        new = step(acc["s"], x)
        return F.get(F.transform(F.array(new), lambda s: F.struct(s.alias("s"), F.array_append(acc["out"], s["bin"]).alias("out"))), F.lit(0))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state(acc["s"]).alias("s"), none.alias("out")), element)
        return F.get(F.transform(F.array(inner), lambda i: F.struct(i["s"].alias("s"), F.array_append(acc["out"], i["out"]).alias("out"))), F.lit(0))

    last = F.greatest(F.floor((F.size(items) - 1) / BLOCK).cast("int"), F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    begin = F.struct(zero.alias("s"), F.array().cast("array<array<int>>").alias("out"))
    return F.when(items.isNotNull(), F.aggregate(parts, begin, block, lambda acc: F.flatten(acc["out"])))


def greedy_bins(lengths: Column, most: int | Column, initial: int | Column = 0, most_count: int | None = None) -> Column:
    """Bin of each element: a bin closes when it has something and the next element would pass ``most`` (or ``most_count``).

    Every bin starts at the size ``initial``. Elements larger than a bin stand alone.
    """
    most, initial = (x if isinstance(x, Column) else F.lit(x) for x in (most, initial))
    zero = F.struct(F.lit(0).alias("bin"), F.lit(0).alias("n"), initial.cast("long").alias("size"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] > 0) & (acc["size"] + x > most)
        if most_count is not None:
            full = full | (acc["n"] >= most_count)
        bin_ = acc["bin"] + full.cast("int")
        return F.struct(bin_.alias("bin"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), (F.when(full, initial.cast("long")).otherwise(acc["size"]) + x).alias("size"))

    return _folded(lengths, zero, step)


def sibling_groups(items: Column, most: int) -> Column:
    """Group of each sibling (struct with eligible, length): runs of eligible neighbours merge while their lengths stay within ``most``."""
    zero = F.struct(F.lit(-1).alias("bin"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"))

    def step(acc: Column, x: Column) -> Column:
        joins = x["eligible"] & (acc["n"] == 1) & (acc["size"] + x["length"] <= most)
        size = F.when(joins, acc["size"] + x["length"]).otherwise(x["length"]).cast("long")
        return F.struct((acc["bin"] + (~joins).cast("int")).alias("bin"), x["eligible"].cast("int").alias("n"), size.alias("size"))

    return _folded(items, zero, step)
