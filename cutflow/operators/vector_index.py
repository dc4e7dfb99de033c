"""Exact top-k search over an inverted file of vectors.

Vectors are dealt to the cells of centres that k-means finds in a bounded sample; all vectors are dealt, and every cell
knows how far its farthest vector is from its centre. A query first visits the PROBE cells of the greatest products with
their centres, which gives it a k-th score; after that it visits every other cell in which, by the cell's reach, a vector
could still score as much. So results are those of a full search, whatever the centres are.

There is one plan for any number of queries: they are rows, routed to cells, and cells meet in tiles.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..tables import staged
from .similar import _matrix, in_tiles, usable

SAMPLE = 20_000  # vectors to which the centres are fitted
CELLS = 256  # of each length, at most
MEMBERS = 64  # sampled vectors for each centre, at least
CELL = 4096  # vectors of a cell, about, while there are fewer than CELLS
ROUNDS = 8  # of k-means
PROBE = 4  # cells that a query visits first
SLACK = 1e-9


def _centres(m: np.ndarray, most: int) -> np.ndarray:
    """k-means of the rows, from rows that are spread out in their order."""
    count = max(1, min(CELLS, most, len(m) // MEMBERS))
    c = m[np.linspace(0, len(m) - 1, count).astype(int)].copy()
    for _ in range(ROUNDS):
        own = ((c * c).sum(1) - 2 * m @ c.T).argmin(1)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=count)
        np.add.at(sums, own, m)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Centres(NamedTuple):
    points: dict[int, np.ndarray]

    def of(self, length: int) -> np.ndarray:
        return self.points.get(length, np.zeros((1, length)))


def centres(vectors: DataFrame) -> Centres:
    """Of vectors(id, v), by those of the least hashes, SAMPLE at most."""
    most, by_length = vectors.count() // CELL, {}
    for r in vectors.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect():
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    return Centres({n: _centres(np.array(some, float).reshape(len(some), n), most) for n, some in by_length.items()})


def _deal(held):
    """Vectors with their length, cell and distance from its centre."""

    def run(batches):
        for b in batches:
            lengths = np.diff(b.column("v").offsets.to_numpy())
            for length in np.unique(lengths).tolist():
                rows = pa.array(np.flatnonzero(lengths == length))
                part = pa.Table.from_batches([b]).take(rows)
                m, c = _matrix(part["v"]), held.value.of(length)
                cell = ((c * c).sum(1) - 2 * m @ c.T).argmin(1)
                away = np.sqrt(((m - c[cell]) ** 2).sum(1))
                for name, x in (("length", pa.array(np.full(len(m), length, np.int32))), ("cell", pa.array(cell.astype(np.int32))), ("away", pa.array(away))):
                    part = part.append_column(name, x)
                yield from part.to_batches()

    return run


def _route(held, schema: pa.Schema, first: bool, least: float):
    """query_id, q, group, cells (cell, away), kth -> a row for each cell that the query has to visit."""

    def run(batches):
        for b in batches:
            rows, cells = [], []
            ids = b.column("q").to_pylist()
            for k, (q, known, kth) in enumerate(zip(ids, b.column("cells").to_pylist(), b.column("kth").to_pylist(), strict=True)):
                q, numbers = np.array(q, float), np.array([x["cell"] for x in known if x["length"] == len(q)], int)
                if not len(numbers):
                    continue
                reach = np.array([x["away"] for x in known if x["length"] == len(q)])
                products = held.value.of(len(q))[numbers] @ q
                order = np.argsort(-products, kind="stable")
                if not first:
                    order = order[PROBE:]
                    norm = np.sqrt((q * q).sum())
                    bound = products + norm * reach + SLACK * (1 + norm)
                    order = order[bound[order] >= (least if kth is None else max(kth, least))]
                else:
                    order = order[:PROBE]
                rows += [k] * len(order)
                cells += numbers[order].tolist()
            if rows:
                part = pa.Table.from_batches([b]).take(pa.array(rows))
                length = pa.array(np.diff(b.column("q").offsets.to_numpy())[rows].astype(np.int32))
                yield from pa.table([part["query_id"], part["q"], part["group"], length, pa.array(cells, pa.int32())], schema=schema).to_batches()

    return run


def _best(schema: pa.Schema, k: int, least: float):
    """The best k of a tile's vectors for each of its queries; scores are summed in order."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, v, ids = _matrix(left["q"]), _matrix(right["v"]), right["vec_id"].to_numpy()
        kk, rows, found, scores = min(k, len(v)), [], [], []
        for at in range(0, len(q), 64):
            near = q[at : at + 64] @ v.T
            edge = np.partition(near, len(v) - kk, axis=1)[:, len(v) - kk]
            slack = SLACK * (1 + np.abs(near).max())
            i, j = np.nonzero(near >= np.maximum(edge, least)[:, None] - slack)
            score = np.cumsum(q[at + i] * v[j], axis=1)[:, -1] if v.shape[1] else np.zeros(len(i))
            order = np.lexsort((ids[j], -score, i))
            order = order[score[order] >= least]
            start = np.searchsorted(i[order], np.arange(len(near)))
            order = order[np.arange(len(order)) - start[i[order]] < kk]
            rows.append(at + i[order])
            found.append(j[order])
            scores.append(score[order])
        rows, found, scores = map(np.concatenate, (rows, found, scores))
        left, right = left.take(pa.array(rows)), right.take(pa.array(found))
        return pa.table([left["query_id"], left["group"], right["per"], right["vec_id"], pa.array(scores)], schema=schema)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0, per: str | None = None) -> DataFrame:
    """vectors(vec_id, embedding, ...), queries(query_id, q), a stated set -> query_id, [per], vec_id, score, rank.

    score is the dot product; of each query (and of each `per`) the best k that reach min_score, ties by vec_id, k being
    1 at least. Null vectors and those with nulls or other lengths than the query are never found. Any query may find
    any number of equal vectors; a tile hands on k of them."""
    k, spark = max(1, k), vectors.sparkSession
    group = F.to_json(F.struct(F.col(per))) if per else F.lit("")
    label = F.col(per) if per else F.lit(None).cast("int")
    double = lambda c: F.col(c).cast("array<double>")
    v = vectors.select("vec_id", double("embedding").alias("v"), group.alias("group"), label.alias("per")).where(usable(F.col("v")))
    held = spark.sparkContext.broadcast(centres(v.select(F.col("vec_id").alias("id"), "v")))  # CELLS of each length at most
    kinds = {f.name: f.dataType.simpleString() for f in v.schema}
    dealt = staged(v.mapInArrow(_deal(held), f"vec_id {kinds['vec_id']}, v array<double>, `group` string, per {kinds['per']}, length int, cell int, away double"), "dealt")
    cells = dealt.groupBy("group", "length", "cell").agg(F.max("away").alias("away"))
    lists = staged(cells.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("length", "cell", "away"))).alias("cells")), "cells")
    q = queries.select("query_id", double("q").alias("q")).where(usable(F.col("q")))
    kind = dict(q.dtypes)["query_id"]
    routed = f"query_id {kind}, q array<double>, `group` string, length int, cell int"
    arrow = lambda text: pa.schema([(c, t) for c, t in text])
    types = {f.name: pa.field(f.name, _arrow_type(f.dataType)) for f in [*q.schema, *v.schema]}
    route_schema = arrow([("query_id", types["query_id"].type), ("q", pa.list_(pa.float64())), ("group", pa.string()), ("length", pa.int32()), ("cell", pa.int32())])
    best_schema = arrow([("query_id", types["query_id"].type), ("group", pa.string()), ("per", types["per"].type), ("vec_id", types["vec_id"].type), ("score", pa.float64())])

    def search(tasks: DataFrame, first: bool) -> DataFrame:
        visits = tasks.mapInArrow(_route(held, route_schema, first, min_score), routed)
        found = in_tiles(visits, dealt.select("vec_id", "v", "group", "per", "length", "cell"), ["group", "length", "cell"], _best(best_schema, k, min_score), f"query_id {kind}, `group` string, per {kinds['per']}, vec_id {kinds['vec_id']}, score double", "query_id", "vec_id")
        return ranked(found)

    def ranked(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id", "group").orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    # Of each query and group a row, as each has its own result.
    tasks = q.crossJoin(lists)
    columns = ["query_id", *([F.col("per").alias(per)] if per else []), "vec_id", "score", "rank"]
    begun = search(tasks.withColumn("kth", F.lit(None).cast("double")), True)
    if (lists.agg(F.max(F.size("cells"))).first()[0] or 0) <= PROBE:  # the first visit is to all cells
        return begun.select(*columns)
    begun = staged(begun, "first")
    kth = begun.where(F.col("rank") == k).select("query_id", "group", F.col("score").alias("kth"))
    rest = search(tasks.join(kth, ["query_id", "group"], "left"), False)
    out = ranked(begun.drop("rank").unionByName(rest.drop("rank")))
    return out.select(*columns)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
