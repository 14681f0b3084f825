"""Text embedders: one vector for each overlapping chunk of a text. The hashing embedder needs no model; others plug in the same way."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

DIM, CHUNK, STRIDE = 128, 512, 50
Embedder = Callable[[list[str]], list[list[list[float]]]]


def chunks(n: int, size: int = CHUNK, stride: int = STRIDE) -> list[tuple[int, int]]:
    """Ranges of so many tokens, each beginning stride tokens before the last one ended; one, empty, for an empty text."""
    out, a = [], 0
    while True:
        out.append((a, min(a + size, n)))
        if a + size >= n:
            return out
        a += size - stride


def hash_embedder(texts: list[str]) -> list[list[list[float]]]:
    """Signed hashing of words into 128 components, at length 1."""
    import zlib

    out = []
    for text in texts:
        words = re.findall(r"\w+", text.lower())
        code = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
        vectors = []
        for a, b in chunks(len(words)):
            v = np.bincount(code[a:b] % DIM, np.where(code[a:b] >> 31 & 1, -1.0, 1.0), DIM) if b > a else np.zeros(DIM)
            norm = np.sqrt((v * v).sum())
            vectors.append((v / norm if norm else v).tolist())
        out.append(vectors)
    return out


def embedded(spark: SparkSession, text: Column, embedder: Embedder = hash_embedder) -> Column:
    """array<array<double>>: the vectors of a text's chunks, null for a null text. An embedder that fails fails the task, which is tried again."""
    ship(spark)

    def run(t: pa.Array) -> pa.Array:
        at = [i for i, x in enumerate(t.to_pylist()) if x is not None]
        got = embedder([t[i].as_py() for i in at]) if at else []
        out: list = [None] * len(t)
        for i, v in zip(at, got):
            out[i] = v
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    run.__annotations__ = {"t": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<array<double>>")(text)
