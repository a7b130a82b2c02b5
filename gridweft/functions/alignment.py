"""Sequence alignment of two arrays inside one row, with an exact growing band."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweft.functions.bind import bind

# Half-widths tried in turn; the last one is wider than any array Spark can hold.
_BANDS = (0, 2, 8, 32, 128, 512, 2048, 8192, 32768, 131072, 2**30)


def edit_ratio(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; two empty texts give 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest.cast("double"))


def align_cost(
    xs: Column,
    ys: Column,
    x_weights: Column,
    y_weights: Column,
    cost: Callable[[Column, Column], Column],
) -> Column:
    """Least cost of turning ``xs`` into ``ys`` by deleting, inserting and replacing elements in order.

    Deleting or inserting an element costs its weight, replacing costs ``cost(x, y)``.  Only a band around
    the diagonal is computed.  A path outside a band of half-width ``w`` needs at least
    ``|m - n| + 2 (w + 1)`` insertions and deletions, so a result up to that many times the least weight is
    final; otherwise the band grows, at last to the whole matrix.  Similar arrays therefore cost
    about one diagonal instead of all pairs.
    """

    def prepared(env: Column) -> Column:
        xs, ys, wx, wy = env["xs"], env["ys"], env["wx"], env["wy"]
        m, n = F.size(xs), F.size(ys)
        diff = n - m
        least = F.least(F.array_min(wx), F.array_min(wy))
        empty = F.array().cast("array<double>")

        def band(w: Column) -> Column:
            lo = F.least(F.lit(0), diff) - w
            lo = F.greatest(lo, -m)
            last = F.least(F.greatest(F.lit(0), diff) + w, n) - lo

            def next_row(prev: Column, i: Column) -> Column:
                def next_value(acc: Column, o: Column) -> Column:
                    j = i + lo + o
                    diagonal = F.get(prev, o)
                    value = F.when(
                        (j >= 0) & (j <= n),
                        F.when((i == 0) & (j == 0), F.lit(0.0)).otherwise(
                            F.least(
                                F.get(acc, o - 1) + F.get(wy, j - 1),
                                F.get(prev, o + 1) + F.get(wx, i - 1),
                                F.when(
                                    diagonal.isNotNull() & (j > 0),
                                    diagonal + cost(F.get(xs, i - 1), F.get(ys, j - 1)),
                                ),
                            )
                        ),
                    )
                    return F.concat(acc, F.array(value))

                return F.aggregate(F.sequence(F.lit(0), last), empty, next_value)

            final = F.aggregate(F.sequence(F.lit(0), m), empty, next_row)
            return F.get(final, diff - lo)

        def step(state: Column, w: Column) -> Column:
            limit = (F.abs(diff) + 2 * (w + 1)).cast("double") * least
            widest = w >= F.greatest(m, n)
            tried = bind(
                band(F.least(w, F.greatest(m, n))),
                lambda d: F.struct(d.alias("d"), (widest | (d <= limit)).alias("done")),
            )
            return F.when(state["done"], state).otherwise(tried)

        start = F.struct(F.lit(0.0).alias("d"), F.lit(False).alias("done"))
        searched = F.aggregate(F.array(*[F.lit(b) for b in _BANDS]), start, step, lambda s: s["d"])
        total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
        return F.when(m == 0, total(wy)).when(n == 0, total(wx)).otherwise(searched)

    env = F.struct(xs.alias("xs"), ys.alias("ys"), x_weights.alias("wx"), y_weights.alias("wy"))
    return bind(env, prepared)
