"""Ordered and unordered proximity over arrays of positions, as folds inside Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def near(lists: Column, distance: Column) -> Column:
    """Last positions of ordered matches of an array of position arrays.

    A match takes a position of each argument, each more than the one before by at most ``distance``. Matches
    don't overlap: for each position of the first argument the later ones take their first free position beyond
    the one before it; if some gap is too wide the next first position is tried.
    """
    rest = F.slice(lists, F.lit(2), F.greatest(F.size(lists) - 1, F.lit(0)))
    empty = F.array().cast("array<int>")
    start = F.struct(F.transform(rest, lambda _: F.lit(-1)).alias("used"), empty.alias("out"))

    def step(s: Column, first: Column) -> Column:
        indexed = F.arrays_zip(rest.alias("p"), s["used"].alias("u"))

        def follow(c: Column, arg: Column) -> Column:
            prev = F.element_at(c, -1)
            return F.concat(c, F.array(F.array_min(F.filter(arg["p"], lambda x: (x > prev) & (x > arg["u"])))))

        chain = F.aggregate(indexed, F.array(first), follow)
        gaps = F.zip_with(F.slice(chain, F.lit(1), F.size(chain) - 1), F.slice(chain, F.lit(2), F.size(chain) - 1), lambda a, b: b - a)
        good = F.coalesce(F.forall(gaps, lambda g: g <= distance), F.lit(False))
        taken = F.struct(F.slice(chain, F.lit(2), F.size(chain) - 1).alias("used"), F.concat(s["out"], F.array(F.element_at(chain, -1))).alias("out"))
        return F.when(good, taken).otherwise(s)

    return F.aggregate(F.element_at(lists, 1), start, step, lambda s: s["out"])


def window(lists: Column, distance: Column) -> Column:
    """Greatest positions of unordered matches of an array of position arrays.

    One cursor walks each array. Where the cursors' positions span fewer than ``distance`` it is a match and all
    move on; else the one at the least position moves (the first on ties); the end of any array ends it.
    """
    empty = F.array().cast("array<int>")
    start = F.struct(F.transform(lists, lambda _: F.lit(1)).alias("at"), empty.alias("out"))
    total = F.aggregate(lists, F.lit(0), lambda n, x: n + F.size(x))

    def step(s: Column, _: Column) -> Column:
        now = F.zip_with(lists, s["at"], lambda p, i: F.get(p, i - 1))
        least = F.array_min(now)
        done = F.exists(now, lambda x: x.isNull())
        match = F.array_max(now) - least < distance
        slowest = F.array_position(now, least).cast("int")
        advanced = F.transform(s["at"], lambda i, k: i + (match | (k + 1 == slowest)).cast("int"))
        moved = F.struct(advanced.alias("at"), F.when(match, F.concat(s["out"], F.array(F.array_max(now)))).otherwise(s["out"]).alias("out"))
        return F.when(done, s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), start, step, lambda s: s["out"])


def synonyms(lists: Column) -> Column:
    """The sorted union of position arrays."""
    return F.array_sort(F.array_distinct(F.flatten(lists)))
