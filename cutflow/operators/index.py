"""A vector index of shots: written and read as a table, described, searched by text or by a vector."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.features import DIM, l2, text_vector
from .vector_index import top_k


def pair_by_position(left: DataFrame, right: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows of two tables at the same place of a key; a key with more places on one side than on the other is an error."""
    sizes = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key, "full")
    checked = sizes.select(key, F.when(F.col("_l") == F.col("_r"), F.lit(True)).otherwise(F.raise_error(F.lit("sides of different lengths"))).alias("_same"))
    return left.join(right, [key, pos]).join(checked, key).where("_same").drop("_same")


VERSION = 1  # of the layout


def save_index(records: DataFrame, vectors: DataFrame, key: str, path: str, embedder: str = "keywords", supports_text: bool = True) -> None:
    """Records and their unit vectors, row by row of the same key, as one table, and a header of one row beside it."""
    joined = records.join(vectors, key).withColumn("embedding", l2(F.transform("embedding", lambda x: x.cast("double"))))
    joined.write.mode("overwrite").parquet(f"{path}/shots")
    about = load_rows(joined.sparkSession, path).agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"), F.count("*").alias("count"))
    about = about.select(F.lit(VERSION).alias("version"), F.lit(embedder).alias("embedder"), "dim", F.lit(supports_text).alias("supports_text"), "count")
    about.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/shots")


def header(spark: SparkSession, path: str) -> DataFrame:
    """version, embedder, dim, supports_text and count of an index, without its shots."""
    return spark.read.schema("version int, embedder string, dim int, supports_text boolean, count bigint").json(f"{path}/header")


def load_index(spark: SparkSession, path: str, dim: int | None = None, for_text: bool = False) -> DataFrame:
    """The shots of an index whose header fits: this layout's version, dim values if given, an embedder of texts if asked."""
    h = header(spark, path).first()
    if h is None or h["version"] != VERSION:
        raise ValueError(f"no index of version {VERSION}: {path}")
    if dim is not None and h["count"] and h["dim"] != dim:
        raise ValueError(f"the index has vectors of {h['dim']} values, not {dim}")
    if for_text and not h["supports_text"]:
        raise ValueError(f"the embedder {h['embedder']} takes no texts")
    return load_rows(spark, path)


def describe(index: DataFrame, source: str = "source_video") -> DataFrame:
    """shots, dim and videos of an index; reads no vectors but their lengths."""
    return index.agg(F.count("*").alias("shots"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"), F.count_distinct(source).alias("videos"))


def search_text(index: DataFrame, queries: DataFrame, k: int = 10, min_score: float = 0.0) -> DataFrame:
    """queries(query_id, query), a stated set -> query_id, vec_id, score, rank, by keyword vectors of DIM values."""
    return top_k(index, queries.select("query_id", text_vector(F.col("query")).alias("q")), k, min_score)


def search(index: DataFrame, k: int = 10, min_score: float = 0.0, texts: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """By texts or by vectors(query_id, q), not by both or neither; vectors must have the index's length."""
    if (texts is None) == (vectors is None):
        raise ValueError("either texts or vectors")
    if texts is not None:
        return search_text(index, texts, k, min_score)
    dim = index.select(F.size("embedding").alias("n")).first()
    if dim and not vectors.where(F.size("q") != dim["n"]).isEmpty():
        raise ValueError(f"the index has vectors of {dim['n']} values")
    return top_k(index, vectors, k, min_score)


def image_features(pixels: Column) -> Column:
    """struct of brightness, contrast, saturation and warmth of an array of (r, g, b) in [0, 1]."""
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    gray = F.transform(pixels, lambda p: p["r"] * 0.299 + p["g"] * 0.587 + p["b"] * 0.114)
    spread = F.sqrt(F.greatest(mean(F.transform(gray, lambda x: x * x)) - F.pow(mean(gray), F.lit(2.0)), F.lit(0.0)))
    top, low = lambda p: F.greatest(p["r"], p["g"], p["b"]), lambda p: F.least(p["r"], p["g"], p["b"])
    color = F.transform(pixels, lambda p: F.when(top(p) > 1e-6, (top(p) - low(p)) / F.greatest(top(p), F.lit(1e-6))).otherwise(F.lit(0.0)))
    warm = (mean(F.transform(pixels, lambda p: p["r"])) - mean(F.transform(pixels, lambda p: p["b"])) + 1) / 2
    return F.struct(mean(gray).alias("brightness"), F.least(F.lit(1.0), spread / 0.35).alias("contrast"), mean(color).alias("saturation"), warm.alias("warmth"))


def image_vector(pixels: Column) -> Column:
    """Unit vector of an image: its four features around their middle."""
    f = image_features(pixels)
    return l2(F.array(*[f[c] - 0.5 for c in ("brightness", "contrast", "saturation", "warmth")]))


def search_image(index: DataFrame, images: DataFrame, k: int = 10, min_score: float = 0.0) -> DataFrame:
    """images(query_id, pixels), a stated set -> query_id, vec_id, score, rank; the index holds image_vectors."""
    return search(index, k, min_score, vectors=images.select("query_id", image_vector(F.col("pixels")).alias("q")))


def embed(items: DataFrame, column: str, encoder, dim: int = DIM) -> DataFrame:
    """items with embedding: what encoder, a function of a column, makes of one, scaled to length 1; a null becomes zeros."""
    raw = F.coalesce(encoder(F.col(column)), F.array_repeat(F.lit(0.0), dim))
    return items.withColumn("embedding", l2(F.transform(raw, lambda x: x.cast("double"))))
