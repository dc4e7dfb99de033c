"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel over a few statistics of a document. Every partition sums its share of the
normal equations; ridge regression solves them, and isotonic regression on labelled documents kept aside turns its
scores into probabilities.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import staged, table

LABELLED = 20_000  # at most so many labelled documents are learnt from, those with the smallest hash of their id
WIDTH = 256  # random features
RIDGE = 1e-3  # times the number of rows
SEED = 20240607
FOLDS = 5  # one of them calibrates

CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>", b"!?", b"|", b".,;:'\"()-", b" \t\n\r\x0b\x0c", bytes(range(128, 256))]
_OF = np.zeros((256, len(CLASSES)))
for _k, _c in enumerate(CLASSES):
    _OF[list(_c), _k] = 1
N_STATS = 18


def statistics(text: bytes | None) -> list[float]:
    """Statistics of a text that tell prose from junk; zeros for a null or blank text."""
    w = (text or b"").split()
    if not w:
        return [0.0] * N_STATS
    n, lines = len(w), [x for x in text.split(b"\n") if x.strip()]
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _OF / len(text)
    letters = share[0] + share[1] + share[8] + 1e-9
    marked = sum(x[-1:] in b"!#*$%&|" for x in w) / n
    return [
        math.log1p(n),
        (len(text) - n) / n / 10,
        *share[[2, 3, 4, 5, 6, 8]],
        share[0] / letters,
        len(set(w)) / n,
        math.log1p(len(set(w))) / math.log1p(n),
        sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
        marked,
        sum(x[-1:] in b"." for x in w) / n,
        sum(x[:1].isupper() for x in w) / n,
        len(lines) / n,
        len(set(lines)) / len(lines),
        math.log1p(max(map(len, w))) / 10,
    ]


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class Projection:
    """Standardised statistics -> random Fourier features with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = rng.normal(size=(len(mean), WIDTH)) / math.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * math.pi, WIDTH)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([math.sqrt(2 / WIDTH) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _normal_equations(project: Projection):
    """Of each partition: its sums of products of features, and of features and labels, a row each (k, v)."""

    def run(batches):
        total = np.zeros((WIDTH + 1, WIDTH + 2))
        for b in batches:
            z = project(np.array(b.column(0).to_pylist(), float).reshape(-1, N_STATS))
            total += z.T @ np.hstack([z, b.column(1).to_numpy(zero_copy_only=False)[:, None]])
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centres, values) of the blocks of the best non-decreasing fit, x ascending."""
    blocks: list[list[float]] = []
    for row in zip(x * weight, y * weight, weight, strict=True):
        blocks.append(list(row))
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    a = np.array(blocks)
    return a[:, 0] / a[:, 2], a[:, 1] / a[:, 2]


def _scored(project: Projection, w: np.ndarray, knots: np.ndarray, heights: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in _texts(b.column(1))]).reshape(-1, N_STATS)
            yield pa.record_batch([b.column(0), pa.array(np.round(np.interp(project(x) @ w, knots, heights), 12))], schema=schema)  # so that equal texts have equal scores in every batch

    return run


def held_out(doc_id) -> F.Column:
    """Rows whose crc32(doc_id as text) mod 3 is 1; never learnt from. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, y, fold of at most `most` labelled documents outside the held-out part; bounded, so it can be broadcast.

    A document with several labels counts as bad if one of them is; null labels and ids are left out."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "y", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)) == 0).alias("calibrates"))


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality, ...) -> doc_id, held_out, score, predicted.

    Every whole text is scored from its statistics alone. Null and blank texts have all statistics zero and get a score
    as others do; rows without doc_id are scored; repeated rows come out repeated. Without training labels, or with
    those of one class only, every score is that class' share (0.5 without labels). Other columns are ignored."""
    docs = docs.select("doc_id", "text")

    def rows(batches):
        for b in batches:
            x = pa.array([statistics(t) for t in _texts(b.column(0))], pa.list_(pa.float64()))
            yield pa.record_batch([x, b.column(1), b.column(2)], ["x", "y", "calibrates"])

    train = docs.join(F.broadcast(training_labels(labels, most)), "doc_id").select("text", "y", "calibrates").mapInArrow(rows, "x array<double>, y double, calibrates boolean")
    train = staged(train, "statistics")
    fit = train.where("not calibrates")
    moments = {r["k"]: r for r in fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale")).collect()}
    seen = train.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if not moments or seen["lo"] == seen["hi"]:
        same = 0.5 if seen["lo"] is None else seen["lo"]
        scored = docs.select("doc_id", F.lit(float(same)).alias("score"))
    else:
        project = Projection(np.array([moments[k]["mean"] for k in range(N_STATS)]), np.array([moments[k]["scale"] for k in range(N_STATS)]))
        parts = fit.select("x", "y").mapInArrow(_normal_equations(project), "k long, v double")
        sums = np.zeros((WIDTH + 1) * (WIDTH + 2))
        for r in parts.groupBy("k").agg(F.sum("v").alias("v")).collect():  # as many rows as the matrix has entries
            sums[r["k"]] = r["v"]
        sums = sums.reshape(WIDTH + 1, WIDTH + 2)
        w = np.linalg.solve(sums[:, :-1] + RIDGE * sums[-1, -2] * np.eye(WIDTH + 1), sums[:, -1])

        def raw(batches):
            for b in batches:
                z = project(np.array(b.column(0).to_pylist(), float).reshape(-1, N_STATS))
                yield pa.record_batch([pa.array(z @ w), b.column(1)], ["s", "y"])

        # Scores are calibrated in steps of a thousandth, so few rows reach the driver.
        aside = train.where("calibrates").select("x", "y").mapInArrow(raw, "s double, y double")
        steps = sorted((r["s"], r["y"], r["n"]) for r in aside.groupBy(F.round("s", 3).alias("s")).agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect())
        s, y, n = np.array(steps or [(0, 0, 1), (1, 1, 1)], float).T
        knots, heights = isotonic(s, y, n)
        scored = docs.mapInArrow(_scored(project, w, knots, np.clip(heights, 0, 1)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
