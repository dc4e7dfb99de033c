"""Packing of tokenised documents into training sequences by vector best-fit."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import staged, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
CACHE = 1_000_000  # chunks of text whose ids a worker remembers
MARKS = b".,;:!?%&*#$|"

_cache: dict[bytes, bytes] = {}


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, the same as the tokenizer gives for the text.

    The tokenizer's pre-tokens never cross white space, so ids are remembered for each chunk between ASCII white space.
    A-Z may be lowered beforehand, as the tokenizer lowers them itself, unless a special token could be in the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def _all(self, chunks: list[str]) -> list[bytes]:
        """Chunks of letters only, as one text: each is one pre-token then, unless lowering it makes other characters."""
        encoded = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        word = np.array(encoded.word_ids, np.int64)
        if len(word) == 0 or word[-1] != len(chunks) - 1:
            return self._each(chunks)
        ids, at = np.array(encoded.ids, "<u4"), np.searchsorted(word, np.arange(len(chunks) + 1))
        return [ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]

    def _learn(self, chunks: set[bytes]) -> None:
        if len(_cache) + 2 * len(chunks) > CACHE:
            _cache.clear()
        stems, marked = {c: c.rstrip(MARKS) for c in chunks}, {}
        letters, other = {}, []
        for c, stem in stems.items():
            x = stem.decode("utf-8", "surrogatepass")
            if not x.isalpha():
                other.append(c)
                continue
            if len(stem) < len(c):  # letters, then marks: two pre-tokens
                marked[c] = stem
                if c[len(stem) :] not in _cache:
                    other.append(c[len(stem) :])
            if stem not in _cache:
                letters[stem] = x
        for encode, some in ((self._all, letters), (self._each, {c: c.decode("utf-8", "surrogatepass") for c in other})):
            if some:
                _cache.update(zip(some, encode([*some.values()]), strict=True))
        _cache.update((c, _cache[stem] + _cache[c[len(stem) :]]) for c, stem in marked.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t if b"<|" in t else t.lower()).split() for t in ((x or "").encode("utf-8", "surrogatepass") for x in texts)]
        needed = set().union(*split)
        missing = needed.difference(_cache)
        if missing:
            if len(_cache) + 2 * len(missing) > CACHE:
                missing = needed  # the cache is about to be cleared
            self._learn(missing)
        return [b"".join(map(_cache.__getitem__, s)) for s in split]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    schema = pa.schema([*PIECES_ARROW, *([("ids", pa.list_(pa.int64()))] if with_ids else [])])

    def run(batches):
        encoder, end = ChunkEncoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(docs), 500):
                out: list[list] = [[] for _ in schema]
                for d, ids in zip(docs[lo : lo + 500], encoder.encode(texts[lo : lo + 500]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        row = (d, k, at // 4, len(cut) // 4, zlib.crc32(cut), np.frombuffer(cut, "<u4").astype(np.int64))
                        for o, v in zip(out, row, strict=False):
                            o.append(v)
                yield pa.record_batch([pa.array(o, f.type) for o, f in zip(out, schema, strict=True)], schema=schema)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> a row for each piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for).

    A document is its ids and one end id; null and empty texts are the end id alone. Only what is longer than capacity
    is cut. Rows are independent: repeated rows and null ids come out as they came in."""
    schema = PIECES + (", ids array<long>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), schema)


def vector_best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; lengths must not increase. Capacities: tokens, documents, attention cost (squared
    lengths). An item goes to the bin, of those that hold it in every dimension, with the least weighted norm of what
    would be left ("norm"), or the largest weighted dot product of demand and residual ("dot"); ties: the oldest."""
    demand = np.stack([lengths, np.ones_like(lengths), lengths.astype(np.float64) ** 2], 1) / capacity
    room, ids = np.empty((len(lengths), 3)), np.empty(len(lengths), np.int64)  # open bins: what is left, and their number
    used = np.zeros(len(lengths), np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    m = made = 0
    least = demand[-1] - 1e-12 if len(lengths) else None
    for i, d in enumerate(demand):
        left = room[:m] - d
        fits = np.flatnonzero((left >= -1e-12).all(1))
        if len(fits):
            score = (left[fits] ** 2) @ weights if rule == "norm" else -(room[fits] * d) @ weights
            j = fits[np.argmin(score)]
        else:
            j, m = m, m + 1
            room[j], ids[j] = 1.0, made
            made += 1
        room[j] -= d
        bins[i], offsets[i] = ids[j], used[ids[j]]
        used[ids[j]] += lengths[i]
        if (room[j] < least).any():  # not even the smallest item fits
            m -= 1
            ids[j:m], room[j:m] = ids[j + 1 : m + 1].copy(), room[j + 1 : m + 1].copy()
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, max_docs: int = 1024, max_cost: float | None = None, weights=(1.0, 0.01, 0.01), rule: str = "norm", group: int = 8192) -> DataFrame:
    """pieces(doc_id, piece, length, ids_crc32, ...) -> the same rows with sequence_id and offset.

    Pieces are dealt by hash into groups of about `group`, whatever the input's size; each group is packed on its own,
    longest pieces first. A group wastes part of one sequence at most beyond what best-fit wastes, so bounded groups
    cost a small part of a thousandth of the sequences. Every sequence holds at most capacity tokens, max_docs pieces
    and max_cost attention cost (capacity squared unless given); a piece over max_cost has a sequence of its own.
    An empty table gives an empty one; rows with equal keys are separate pieces. pieces should be a written table, whose
    rows keep their places."""
    limits = np.array([capacity, max_docs, max_cost or float(capacity) ** 2], np.float64)
    n = max(1, -(-pieces.count() // group))
    columns = pieces.columns

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["_g"].iloc[0])
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = vector_best_fit(pdf["length"].to_numpy(), limits, np.asarray(weights), rule)
        return pdf.assign(sequence_id=bins + (g << 32), offset=offsets)[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    # The row's place is part of the hash, so that equal rows don't meet in one group.
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(n)))
    return dealt.groupBy("_g").applyInPandas(fit, schema)


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, **options) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(staged(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity, **options)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_file())
