"""Array columns: values named once, and running sums that stay linear in long arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_sum(values: Column, block: int = BLOCK) -> Column:
    """Sum up to and including each entry of an array of ints.

    An accumulator that grows by one entry is copied at every step, so one pass over
    n entries would copy n * n / 2 of them.  Blocks are summed by themselves and carry
    the blocks before them: no copy is longer than a block or the number of blocks.
    """
    none = F.array().cast("array<int>")

    def sums(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), none.alias("out"))
        return F.aggregate(part, start, lambda s, v: let(s["sum"] + v, lambda t: F.struct(
            t.alias("sum"), F.array_append(s["out"], t).alias("out"))), lambda s: s["out"])

    def joined(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), none.alias("out"))
        carried = F.aggregate(parts, start, lambda s, p: F.struct(
            (s["sum"] + F.element_at(p, -1)).alias("sum"), F.array_append(s["out"], s["sum"]).alias("out")),
            lambda s: s["out"])
        return F.flatten(F.zip_with(parts, carried, lambda p, c: F.transform(p, lambda v: v + c)))

    def split(whole: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.size(whole), F.lit(block))
        return let(F.transform(cuts, lambda at: sums(F.slice(whole, at, block))), joined)

    return let(values, lambda v: F.when(F.size(v) > 0, split(v)).otherwise(none))


def _runs(entries: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(entries, start, length)`` of every run of equal ``value`` in sorted entries."""
    def cut(rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda e, k: F.when(k == 0, k).when(
            F.element_at(rows, k)["value"] != e["value"], k)), lambda k: k.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda s, k: body(
            rows, s, F.coalesce(F.try_element_at(at, k + 2), F.size(rows)) - s)))

    return let(entries, lambda found: F.when(F.size(found) > 0, let(F.sort_array(found), cut)))


def counted(values: Column) -> Column:
    """The distinct texts of an array as array<struct<value, first, n>>: first place and number of uses.

    A sort and a pass over its runs inside the row; nothing is exchanged.  Null for an empty array.
    """
    placed = F.transform(values, lambda v, k: F.struct(v.alias("value"), k.alias("first")))
    return _runs(placed, lambda rows, s, n: F.struct(
        rows[s]["value"].alias("value"), rows[s]["first"].alias("first"), n.cast("long").alias("n")))
