"""Models as plug-ins: embedders and translators that take batches, one of each for each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

BATCH = 256  # rows that a model gets at a time


class Embedder(Protocol):
    """name, dim and what it can take are known without loading it."""

    name: str
    dim: int
    supports_text: bool

    def encode_texts(self, texts: Sequence[str]) -> np.ndarray: ...

    def encode_images(self, images: Sequence[bytes]) -> np.ndarray: ...


_loaded: dict[Callable, object] = {}


def _model(make: Callable):
    """The worker's own, made once and kept for its later tasks."""
    if make not in _loaded:
        _loaded[make] = make()
    return _loaded[make]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, BATCH):
            yield b.slice(k, BATCH)


def _same(given: int, got: int, name: str) -> None:
    if given != got:
        raise ValueError(f"{name} gave {got} results for {given} inputs")


def embed(items: DataFrame, column: str, make: Callable[[], Embedder], kind: str = "texts") -> DataFrame:
    """items with embedding: the model's vectors, scaled to length 1; nulls and zero vectors become zeros.

    make is a class or a function at the top of a module. kind is texts or images; a model that can't take texts, that
    gives another number of vectors than it got inputs, or vectors of another length than it says, is an error."""
    if kind not in ("texts", "images"):
        raise ValueError(f"texts or images, not {kind}")
    if kind == "texts" and not getattr(make, "supports_text", True):
        raise ValueError(f"{getattr(make, 'name', make)} takes no texts")
    schema = items.select(*[c for c in items.columns if c != "embedding"], F.lit(None).cast("array<double>").alias("embedding")).schema

    def run(batches):
        model = _model(make)
        if kind == "texts" and not model.supports_text:
            raise ValueError(f"{model.name} takes no texts")
        for b in _parts(batches):
            values = b.column(column).to_pylist()
            given = [v for v in values if v is not None]
            found = np.asarray((model.encode_texts if kind == "texts" else model.encode_images)(given), float) if given else np.zeros((0, model.dim))
            _same(len(given), len(found), model.name)
            if found.shape[1:] != (model.dim,):
                raise ValueError(f"{model.name} gave vectors of {found.shape[1:]} values, not {model.dim}")
            out = np.zeros((len(values), model.dim))
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            out[[i for i, v in enumerate(values) if v is not None]] = found / np.where(norm == 0, 1, norm)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * model.dim), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "embedding"), flat], names=[f.name for f in schema])

    return items.mapInArrow(run, schema)


def translate(captions: DataFrame, make: Callable[[], Callable[[Sequence[str]], Sequence[str]]], keep_source: bool = True) -> DataFrame:
    """captions(text, ...) with text2, the translation, trimmed; or, without keep_source, with it in place of text where it
    isn't empty. Times and other columns stay. make gives a function of a batch of texts; one that gives another number of
    texts than it got is an error. Null texts are not sent, and have ''."""
    rest = [c for c in captions.columns if c != "text2"]
    schema = captions.select(*rest, F.lit("").alias("text2")).schema if keep_source else captions.schema
    for f in schema:
        f.nullable = True

    def run(batches):
        translator = _model(make)
        for b in _parts(batches):
            texts = b.column("text").to_pylist()
            given = [t for t in texts if t is not None]
            found = list(translator(given)) if given else []
            _same(len(given), len(found), "the translator")
            each = iter(found)
            new = [(next(each) or "").strip() if t is not None else "" for t in texts]
            columns = {c: b.column(c) for c in b.schema.names}
            columns |= {"text2": pa.array(new, pa.string())} if keep_source else {"text": pa.array([n or t for n, t in zip(new, texts, strict=True)], pa.string())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], names=[f.name for f in schema])

    return captions.mapInArrow(run, schema)
