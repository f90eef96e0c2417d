"""Embedding of texts behind one protocol, and a cache of answers."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.functions import text as T


class Embedder(Protocol):
    model: str
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed counts of hashed words, scaled to unit length: the same for a text everywhere, and without a model."""

    def __init__(self, dims: int = 64):
        self.model, self.dims = f"hashing-{dims}", dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dims] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


def embed_missing(texts: DataFrame, cache: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """Cache rows (hash, model, vector) for the distinct texts that the cache lacks. A text is cut to the length that is embedded, and hashed as cut."""
    cut = F.left("text", F.lit(fixed.TEXT_LIMITS["embedded"]))
    rows = texts.where(F.col("text").isNotNull()).select(T.content_hash(cut, 32).alias("hash"), cut.alias("text")).dropDuplicates(["hash"])
    rows = rows.join(cache.where(F.col("model") == embedder.model).select("hash").distinct(), "hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = pa.array(list(embedder.embed(part.column(1).to_pylist())), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([embedder.model] * part.num_rows), vectors], ["hash", "model", "vector"])

    return rows.mapInArrow(run, "hash string, model string, vector array<float>")


class QueryCache:
    """Answers by their parameters, for ttl seconds, the latest `most` of them; forgotten by group."""

    def __init__(self, ttl: float = 300, most: int = 1000, clock=time.monotonic):
        self.ttl, self.most, self.clock, self.rows = ttl, most, clock, OrderedDict()

    @staticmethod
    def key(**params) -> str:
        return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()

    def get(self, key: str):
        if key in self.rows and self.rows[key][0] > self.clock():
            self.rows.move_to_end(key)
            return self.rows[key][2]
        self.rows.pop(key, None)
        return None

    def put(self, key: str, group: str, answer) -> None:
        self.rows[key] = self.clock() + self.ttl, group, answer
        self.rows.move_to_end(key)
        while len(self.rows) > self.most:
            self.rows.popitem(last=False)

    def forget(self, group: str) -> None:
        self.rows = OrderedDict((k, v) for k, v in self.rows.items() if v[1] != group)
