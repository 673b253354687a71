"""Filling fixed-capacity containers with documents (problem 7).

Hashed word vectors of the documents are projected to three dimensions and ordered along a Hilbert
curve. Spark sorts the documents by their place on the curve in ranges; each range packs neighbours, a
window at a time, the largest first into the fullest container that has room.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.tokens import count_tokens, documents

HASHED, DIMENSIONS, BITS = 4096, 3, 10
#: Documents of a window, and containers kept open from one window to the next.
WINDOW, OPEN = 256, 32


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points (n x dimensions, whole numbers under 2**bits), by Skilling's transform."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        p = q - one
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        t = np.where((x[n - 1] & q) > 0, t ^ (q - one), t)
    x ^= t
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << one | (x[i] >> np.uint64(bit)) & one
    return out.astype(np.int64)


def curve_places(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and place (long) of each row on the curve; null and empty texts are in the middle of the cube."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.random.default_rng(0).standard_normal((HASHED, DIMENSIONS))
        for b in batches:
            off = b.column(1).offsets.to_numpy().astype(np.int64)
            codes = b.column(1).flatten().dictionary_encode()
            bucket = pd.util.hash_array(codes.dictionary.to_numpy(zero_copy_only=False), categorize=False) % HASHED if len(codes.dictionary) else np.zeros(0)
            cell, count = np.unique(np.repeat(np.arange(len(b)), np.diff(off)) * HASHED + bucket[codes.indices.to_numpy()].astype(np.int64), return_counts=True)
            weight, doc = np.log1p(count), cell // HASHED
            rows = matrix[cell % HASHED] * weight[:, None]
            projected = np.stack([np.bincount(doc, rows[:, i], len(b)) for i in range(DIMENSIONS)], 1)
            norm = np.sqrt(np.bincount(doc, weight**2, len(b)))[:, None]
            at = 1 / (1 + np.exp(-1.702 * projected / np.where(norm > 0, norm, 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hilbert(np.minimum(at * 2**BITS, 2**BITS - 1), BITS))], ["key", "place"])

    words = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), F.array().cast("array<string>"))
    return docs.select(F.col(key).cast("long").alias("key"), words.alias("w")).mapInArrow(run, "key long, place long").withColumnRenamed("key", key)


class Packer:
    """Containers of one range, filled window by window."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.free, self.made = capacity, [], 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def pack(self, items: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """item, part, container and size of items (item, size). Only items above the capacity are split, into full containers and a rest."""
        out, rest = [], []
        for item, size in items:
            full, left = divmod(size, self.capacity) if size > self.capacity else (0, size)
            out += [(item, p, self.new(), self.capacity) for p in range(full)]
            if left or not full:
                rest.append((left, item, full))
        for size, item, part in sorted(rest, key=lambda x: -x[0]):
            at = bisect_left(self.free, (size, -1))
            room, container = self.free.pop(at) if at < len(self.free) else (self.capacity, self.new())
            insort(self.free, (room - size, container))
            out.append((item, part, container, size))
        self.free = [x for x in self.free[-OPEN:] if x[0] > 0]
        return out


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int]]]:
    """The rows of all batches in runs of WINDOW, however the batches are cut."""
    held: list[tuple[int, int]] = []
    for b in batches:
        held += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        while len(held) >= WINDOW:
            yield held[:WINDOW]
            held = held[WINDOW:]
    if held:
        yield held


def pack(sized: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """key, part, container_id, n_tokens of sized (key, place, n_tokens).

    One row per document, or per part of one above the capacity. A document without tokens takes no room
    and is in some container all the same. Null sizes count as 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(capacity), TaskContext.get().partitionId() << 32
        for window in windows(batches):
            rows = packer.pack(window)
            item, part, container, size = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(part.astype(np.int32)), pa.array(container + base), pa.array(size)], ["key", "part", "container_id", "n_tokens"])

    rows = sized.select(F.col(key).cast("long").alias("key"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"), "place")
    ordered = rows.repartitionByRange("place", "key").sortWithinPartitions("place", "key").select("key", "n")
    return ordered.mapInArrow(run, "key long, part int, container_id long, n_tokens long").withColumnRenamed("key", key)


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_packed: every document in containers of the largest window_tokens in use, sized by byte_bpe_50k."""
    capacity = spark.read.parquet(f"{sf_dir}/embedding_config.parquet").agg(F.max("window_tokens")).first()[0]
    docs = documents(spark, sf_dir).where(F.col("doc_id").isNotNull())
    return pack(count_tokens(docs).join(curve_places(docs, "doc_id", "text"), "doc_id"), capacity)


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_containers: documents and tokens of each container."""
    return packed(spark, sf_dir).groupBy("container_id").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
