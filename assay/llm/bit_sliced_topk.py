"""Exact top-k search by inner product on a bit-sliced index.

A block keeps the leading bits of every attribute as bitmaps over its rows. A query adds the bitmaps that its weights
call for with carry-save adders, so that the sum of all rows comes out as bitmaps too; the k highest sums are selected
from the most significant bitmap downward, and rows near enough to the last of them are measured exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import Scratch
from assay.llm.vector_blocks import at_every_block, best_first, integer_vectors, measures

#: Bitmaps of an attribute at most; bits below them are left to the exact measuring.
SLICES = 7
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class BitSlicedIndex:
    """Of a block: bitmaps[j * slices + s] has bit s of (x[:, j] - low[j]) >> shift; the last bitmap is empty."""

    x: np.ndarray
    ids: np.ndarray
    uids: np.ndarray
    low: np.ndarray
    shift: int
    slices: int
    bitmaps: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> BitSlicedIndex:
        n, width = x.shape
        low = x.min(axis=0) if n else np.zeros(width, np.int64)
        span = int((x - low).max(initial=0)).bit_length()
        shift, slices = max(0, span - SLICES), min(max(span, 1), SLICES)
        part, words = (x - low) >> shift, -(-n // 64)
        packed = np.zeros((width * slices + 2, words * 8), np.uint8)
        for s in range(slices):
            bits = np.packbits(((part >> s) & 1).astype(np.uint8), axis=0, bitorder="little")
            packed[s : width * slices : slices, : len(bits)] = bits.T
        packed[-1, : -(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
        bitmaps = packed.view(np.uint64)
        return cls(x, ids, uids, low, shift, slices, bitmaps[:-1], bitmaps[-1])

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """For each query (a row of weights) the bitmaps of sum_j w_j * part_j + c, lowest bit first.

        A weight is written in digits -1, 0, 1. A digit calls for a bitmap of its attribute at its power of two, and -1
        for the complement, which adds that power to the sum: c is the same for all rows, and no comparison feels it.
        """
        queries, width = weights.shape
        digits, rest = [], weights.copy()
        while rest.any():
            digit = np.where(rest & 1, 2 - (rest & 3), 0)
            digits.append(digit)
            rest = (rest - digit) >> 1
        out, carried = [], []
        power, last = 0, len(digits) + self.slices - 1
        empty = len(self.bitmaps) - 1
        while power < last or carried:
            stack = carried
            pairs = [(p, power - p) for p in range(len(digits)) if 0 <= power - p < self.slices]
            if pairs:
                digit = np.concatenate([digits[p] for p, _ in pairs], axis=1)
                place = np.concatenate([np.arange(width) * self.slices + s for _, s in pairs])
                order = np.argsort(digit == 0, axis=1, kind="stable")[:, : np.count_nonzero(digit, axis=1).max(initial=0)]
                sign = np.take_along_axis(digit, order, axis=1)
                picked = self.bitmaps[np.where(sign != 0, place[order], empty)]
                picked ^= np.where(sign < 0, ONES, np.uint64(0))[:, :, None]
                stack = [*carried, picked]
            total, carried = add_up(stack, queries, self.bitmaps.shape[1])
            out.append(total)
            power += 1
        return out

    def top(self, weights: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and scores of its k best rows, ties by id; the row whose uid is its own is none."""
        sums = self.sums(weights)
        out = []
        for q, w in enumerate(weights):
            there = self.rows.copy()
            for i in np.flatnonzero(self.uids == own[q]):
                there[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
            bits = [s[q] for s in sums]
            # a row's score is its sum times 2^shift and a constant, give or take what the bits left out hold: a row that
            # is no more than `slack` below the k-th sum may be among the best
            slack = ((1 << self.shift) - 1) * int(np.abs(w).sum())
            limit = kth_sum(bits, there, k) - (slack >> self.shift)
            near = places(at_least(bits, there, limit))
            scores = self.x[near] @ w
            best = best_first(scores, self.ids[near], k)
            out.append((near[best], scores[best]))
        return out


def add_up(stack: list[np.ndarray], queries: int, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bitmaps of one power of two, (query, bitmap, word): their lowest bit, and carries into the next power."""
    held = np.concatenate(stack, axis=1) if stack else np.zeros((queries, 0, words), np.uint64)
    carries = []
    while held.shape[1] > 1:
        third = held.shape[1] // 3
        if third:
            a, b, c = held[:, :third], held[:, third : 2 * third], held[:, 2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            held = np.concatenate([half ^ c, held[:, 3 * third :]], axis=1)
        else:
            carries.append(held[:, :1] & held[:, 1:])
            held = held[:, :1] ^ held[:, 1:]
    return (held[:, 0] if held.shape[1] else np.zeros((queries, words), np.uint64)), carries


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_sum(bits: list[np.ndarray], there: np.ndarray, k: int) -> int:
    """The k-th highest sum among the rows `there`, found from the most significant bitmap downward; 0 for fewer rows."""
    above, equal, value = 0, there, 0
    for power in range(len(bits) - 1, -1, -1):
        ones = equal & bits[power]
        n = count(ones)
        if above + n >= k:
            equal, value = ones, value + (1 << power)
        else:
            above, equal = above + n, equal & ~bits[power]
    return value


def at_least(bits: list[np.ndarray], there: np.ndarray, limit: int) -> np.ndarray:
    """The rows `there` whose sum is limit or more."""
    if limit <= 0:
        return there
    above, equal = np.zeros_like(there), there
    for power in range(len(bits) - 1, -1, -1):
        if limit >> power & 1:
            equal = equal & bits[power]
        else:
            above, equal = above | (equal & bits[power]), equal & ~bits[power]
    return above | equal


def places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_k(df: DataFrame, spark: SparkSession, asks, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of df where `asks` holds, the k highest integer inner products with
    all other rows (all, if fewer), ties by vec_id.

    Components count as floor(256 * x). Rows without an id or a vector, or with a null or non-finite component, neither
    ask nor answer. Vectors of unlike length are compared as if filled up with zeros. Rows that repeat an id are rows of
    their own: each asks, and only the asking row itself is no answer. An empty table gives an empty one, a single row
    none. Other columns of df play no part.
    """
    scratch = Scratch(spark)
    rows = integer_vectors(df, vec_id, vector, scratch, asks=F.coalesce(asks, F.lit(False)))
    n, width, _ = measures(rows)
    queries = rows.where("asks").drop("asks")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query", "query_id", "vec_id", "score")])

    def build(x: np.ndarray, columns: pa.Table) -> BitSlicedIndex:
        return BitSlicedIndex.of(x, columns["vec_id"].to_numpy(), columns["uid"].to_numpy())

    def search(index: BitSlicedIndex, x: np.ndarray, columns: pa.Table) -> list[np.ndarray]:
        uids, ids = columns["uid"].to_numpy(), columns["vec_id"].to_numpy()
        found = index.top(x, uids, k)
        sizes = [len(at) for at, _ in found]
        at, scores = (np.concatenate(c) for c in zip(*found))
        return [np.repeat(uids, sizes), np.repeat(ids, sizes), index.ids[at], scores]

    found = at_every_block(rows.drop("asks"), queries, width, n, build, search, schema)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
