"""Ordered work on keys of any size.

Rows of a key in order of a number usually fit a task. Those of a hot key don't: it is cut into chunks by quantiles of
the number, each chunk is worked on alone, and what it needs of the chunks before or after it is carried over from their
summaries, of which there is one row a chunk. Which keys are hot is counted first; where none is, there is no chunk to
carry from, and the plan has nothing more than a window for each key.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..tables import staged

CHUNK = 1_000_000  # rows of a key in order that a task works on, about
CARRIED = 1_000_000  # summaries that are sent to all tasks; more are joined


def _join(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """A left join with a written table, which goes to all tasks if it is small."""
    return df.join(F.broadcast(small) if small.count() <= CARRIED else small, on, "left")


class Chunks:
    """df with _chunk: rows of a key in a later chunk have a greater t; rows of equal t share a chunk."""

    def __init__(self, df: DataFrame, key: str, t: str):
        self.key, self.w = key, Window.partitionBy(key, "_chunk")
        counts = df.groupBy(key).agg(F.count(t).alias("_n")).where(F.col("_n") > CHUNK)
        self.hot = not counts.isEmpty()
        if not self.hot:
            self.df = df.withColumn("_chunk", F.lit(0))
            return
        hot = staged(counts, "hot")
        parts = F.ceil(F.col("_n") / CHUNK).cast("int")
        most = hot.agg(F.max(parts)).first()[0]
        # One quantile for each chunk of the largest key; smaller ones use every so many.
        found = df.join(F.broadcast(hot), key).groupBy(key, "_n").agg(F.percentile_approx(F.col(t).cast("double"), [(i + 1) / most for i in range(most - 1)] or [1.0], 10 * most).alias("_quantiles"))
        step = F.greatest(F.floor(F.lit(most) / parts).cast("int"), F.lit(1))
        cuts = staged(found.select(key, F.array_sort(F.array_distinct(F.filter("_quantiles", lambda _, i: (i + 1) % step == 0))).alias("_cuts")), "cuts")
        place = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col(t).cast("double")))
        self.df = staged(_join(df, cuts, [key]).withColumn("_chunk", F.greatest(place, F.lit(0))).drop("_cuts"), "chunks")

    def _carry(self, df: DataFrame, sums: dict[str, tuple[Column, str]], back: bool) -> DataFrame:
        if not self.hot:
            kinds = dict(df.limit(0).groupBy(self.key).agg(*[c.alias(n) for n, (c, _) in sums.items()]).dtypes)
            return df.withColumns({n: F.lit(None).cast(kinds[n]) for n in sums})
        per = df.groupBy(self.key, "_chunk").agg(*[c.alias(n) for n, (c, _) in sums.items()])
        w = Window.partitionBy(self.key).orderBy(F.col("_chunk") if back else F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        how = {"max": F.max, "min": F.min, "sum": F.sum, "nearest": lambda c: F.last(c, ignorenulls=True)}
        return _join(df, staged(per.select(self.key, "_chunk", *[how[kind](n).over(w).alias(n) for n, (_, kind) in sums.items()]), "carried"), [self.key, "_chunk"])

    def before(self, df: DataFrame, **sums: tuple[Column, str]) -> DataFrame:
        """df with a column for each name: an aggregate of all earlier chunks of the key, null where there are none. Its
        kind says how chunks are put together: max, min, sum, or nearest, that of the nearest chunk that has one."""
        return self._carry(df, sums, True)

    def after(self, df: DataFrame, **sums: tuple[Column, str]) -> DataFrame:
        """As before, of all later chunks."""
        return self._carry(df, sums, False)


def numbered(chunks: Chunks, df: DataFrame, *order, name: str) -> DataFrame:
    """df with the place of a row among those of its key, from 0."""
    w = chunks.w.orderBy(*order)
    carried = chunks.before(df, _before=(F.count("*"), "sum"))
    return carried.withColumn(name, F.row_number().over(w) - 1 + F.coalesce("_before", F.lit(0))).drop("_before")


def halo(df: DataFrame, key: str, place: str, reach: int, size: int) -> DataFrame:
    """Rows of a key numbered without gaps -> with _block, of size rows each, and copies (_copy) of up to reach rows
    beyond either end of a block, so that a window over a block has what stands around its own rows."""
    block = lambda x: F.floor(x / size)
    at = F.col(place)
    every = F.array_distinct(F.array(block(at), block(F.greatest(at - reach, F.lit(0))), block(at + reach)))
    return df.withColumn("_block", F.explode(every)).withColumn("_copy", F.col("_block") != block(at))
