"""Sequence functions over ordered series: moving averages, smoothing, best windows, down-sampling."""

from __future__ import annotations

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.pandas.types import to_arrow_schema

from . import scan
from .scan import Chunks, halo, numbered

BLOCK = 1_000_000  # rows of a key that share a window


def _folded(alpha: float, schema: pa.Schema, key: str, value: str, start: str):
    """Rows sorted by key and chunk -> the same with ema; each chunk begins with its start, or with its first value."""

    def run(batches):
        now, s = None, None
        for b in batches:
            out = []
            for k, c, v, first in zip(*(b.column(x).to_pylist() for x in (key, "_chunk", value, start)), strict=True):
                if (k, c) != now:
                    now, s = (k, c), first
                if v is not None:
                    s = v if s is None else alpha * v + (1 - alpha) * s
                out.append(s)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:-1]), pa.array(out, pa.float64())], schema=schema)

    return run


def ema(chunks: Chunks, order: list[str], value: str, alpha: float) -> DataFrame:
    """The chunks' rows with ema, the exponential moving average of each key's values in order.

    A chunk's average is an affine map of what it begins with: (1 - alpha)^n s + b. The maps of a hot key's chunks are put
    together in order, one number pair each, and each chunk is then folded from where the ones before it end. Nulls leave
    the average as it is."""
    key = chunks.key

    def fold(df: DataFrame, start: Column) -> DataFrame:
        df = df.withColumn("_start", start.cast("double")).withColumn(value, F.col(value).cast("double"))
        rows = df.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", *order)
        schema = rows.withColumn("ema", F.lit(0.0)).schema
        for f in schema:
            f.nullable = True
        return rows.mapInArrow(_folded(alpha, to_arrow_schema(schema), key, value, "_start"), schema).drop("_start")

    if not chunks.hot:
        return fold(chunks.df, F.lit(None))
    last = F.max_by("ema", F.struct(*order))
    seeded = fold(chunks.df, F.lit(None)).groupBy(key, "_chunk").agg(last.alias("own"), F.count(value).alias("n"))
    mapped = fold(chunks.df, F.lit(0.0)).groupBy(key, "_chunk").agg(last.alias("b"))
    steps = F.array_sort(F.collect_list(F.struct("_chunk", "own", F.pow(F.lit(1 - alpha), F.col("n")).alias("a"), "b", "n")))  # one for each chunk
    empty = F.array(F.lit(None).cast("double"))

    def step(ends: Column, x: Column) -> Column:
        s = F.element_at(ends, -1)
        return F.array_append(ends, F.when(s.isNull(), x["own"]).when(x["n"] == 0, s).otherwise(x["a"] * s + x["b"]))

    per = seeded.join(mapped, [key, "_chunk"]).groupBy(key).agg(steps.alias("x"))
    starts = per.select(key, F.explode(F.arrays_zip(F.col("x._chunk").alias("_chunk"), F.aggregate("x", empty, step).alias("_from"))).alias("x")).where("x._chunk is not null")
    carried = scan._join(chunks.df, scan.staged(starts.select(key, "x._chunk", "x._from"), "starts"), [key, "_chunk"])
    return fold(carried, F.col("_from")).drop("_from")


def smoothed(samples: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.35, k: int = 3) -> DataFrame:
    """samples with ema, the exponential moving average of each key's values in order, and ma, its centred mean over k
    rows, with the ends repeated outwards. order begins with a number. Any alpha from 0 to 1 and any number of rows of a
    key: no task holds more than a chunk, and no array of values is built."""
    c = Chunks(samples, key, order[0])
    placed = numbered(c, ema(c, order, value, alpha), *order, name="_place").drop("_chunk")
    if c.hot:
        placed = halo(scan.staged(placed, "ema"), key, "_place", k // 2, BLOCK)
    else:
        placed = placed.withColumns({"_block": F.lit(0), "_copy": F.lit(False)})
    w = Window.partitionBy(key, "_block").orderBy("_place")
    first, last = F.first("ema").over(w), F.last("ema").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = [F.coalesce(F.lag("ema", -i).over(w), first if i < 0 else last) for i in range(-(k // 2), k // 2 + 1)]
    out = placed.withColumn("ma", sum(near[1:], near[0]) / k).where(~F.col("_copy"))
    return out.select(*samples.columns, "ema", "ma")


def best_window(profile: DataFrame, key: str, i: str, p: str, width: int) -> DataFrame:
    """profile(key, i, p), i counting from 0 -> key, lo, total: the window of `width` values with the greatest sum.

    Of windows within 2 % of the best, the one whose centre is closest to the profile's centroid; then the first."""
    w = Window.partitionBy(key).orderBy(i).rowsBetween(-(width - 1), 0)
    whole = Window.partitionBy(key)
    sums = profile.select(key, i, F.sum(p).over(w).alias("total"), (F.sum(F.col(p) * F.col(i)).over(whole) / F.sum(p).over(whole)).alias("centroid")).where(F.col(i) >= width - 1)
    near = sums.withColumn("best", F.max("total").over(whole)).where("total >= best - 0.02 * abs(best)")
    lo = F.col(i) - (width - 1)
    off = F.abs(lo + (width - 1) / 2 - F.col("centroid"))
    return near.groupBy(key).agg(F.min(F.struct(off.alias("off"), lo.alias("lo"), F.col("total").alias("total"))).alias("x")).select(key, "x.lo", "x.total")


def every(samples: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """Every k-th row of each key, from the first."""
    return samples.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).where(F.col("_n") % k == 0).drop("_n")


def minmax(samples: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """samples with out: the value between the least and the greatest of its key, from 0 to almost 1; 0 where all are equal."""
    ends = samples.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return samples.join(ends, key).withColumn(out, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)).drop("_lo", "_hi")
