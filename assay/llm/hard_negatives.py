"""Hard negatives by an inverted multi-index.

Vectors are cut in two halves, each with a codebook of its own; a pair of codewords is a cell. Half a score is bounded by
the inner product with a codeword and the radius around it, so a heap can visit cells by the sum of two bounds, highest
first, and stop once no cell left can hold a row that belongs into the window that is sought.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import Scratch
from assay.llm.vector_blocks import at_every_block, best_first, integer_vectors, measures

#: Codewords of a half, rows of the sample that codebooks are fitted on, and rounds of fitting. All rows are indexed.
CODEWORDS, SAMPLE_ROWS, ROUNDS = 8, 4096, 8
#: Rows that are looked through first, from as many cells as hold them; each further batch is twice as large.
BATCH = 256


def codebook(half: np.ndarray, size: int = CODEWORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a half of the sampled vectors, from distinct starting points far from each other."""
    centres = half[:1].astype(float)
    far = ((half - centres[0]) ** 2).sum(axis=1)
    while len(centres) < size and far.max(initial=0) > 0:
        centres = np.vstack([centres, half[far.argmax()]])
        far = np.minimum(far, ((half - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = nearest(half, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, half)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (half @ centres.T)).argmin(axis=1)


@dataclass
class MultiIndex:
    """A block's rows in order of their cells; cell (i, j) holds the rows from starts[i, j] to starts[i, j] + sizes[i, j]."""

    x: np.ndarray
    ids: np.ndarray
    uids: np.ndarray
    labels: np.ndarray
    codes: dict
    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray, books: tuple[np.ndarray, np.ndarray], most: int) -> MultiIndex:
        """most: the largest component of any anchor."""
        cut = books[0].shape[1]
        halves = x[:, :cut].astype(float), x[:, cut:].astype(float)
        own = [nearest(h, c) for h, c in zip(halves, books)]
        radii = []
        for h, c, o in zip(halves, books, own):
            radius = np.full(len(c), -1.0)  # of codewords without rows here
            np.maximum.at(radius, o, np.sqrt(((h - c[o]) ** 2).sum(axis=1)))
            radii.append(radius)
        shape = len(books[0]), len(books[1])
        cell = own[0] * shape[1] + own[1]
        order = np.argsort(cell, kind="stable")
        sizes = np.bincount(cell, minlength=shape[0] * shape[1])
        names, code = np.unique(labels[order], return_inverse=True)
        codes = {n: i for i, n in enumerate(names.tolist())}
        starts = np.cumsum(sizes) - sizes
        # products of doubles are exact as long as no sum reaches 2^53
        exact = x.shape[1] * float(np.abs(x).max(initial=0)) * most < 2.0**53
        return cls(x[order].astype(float) if exact else x[order], ids[order], uids[order], code, codes, books, (radii[0], radii[1]), starts.reshape(shape), sizes.reshape(shape))

    def half_bounds(self, anchor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each half: codewords with rows by their upper bound, highest first, those bounds, and the lower ones.

        The bounds are widened by what rounding can do to them.
        """
        cut, out = self.centres[0].shape[1], []
        for part, centres, radius in zip((anchor[:cut], anchor[cut:]), self.centres, self.radii):
            used = np.flatnonzero(radius >= 0)
            middle, length = centres[used] @ part.astype(float), np.sqrt(float((part.astype(float) ** 2).sum()))
            spread = radius[used] * length
            spread += 1e-9 * (np.abs(middle) + spread + length) + 1e-6
            order = np.argsort(-(middle + spread), kind="stable")
            out.append((used[order], (middle + spread)[order], (middle - spread)[order]))
        return out

    def visit(self, anchor: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, start, size) of the cells, by upper bound, highest first: a multi-sequence heap."""
        (first, up_a, low_a), (second, up_b, low_b) = self.half_bounds(anchor)
        heap = [(-(up_a[0] + up_b[0]), 0, 0)] if len(first) and len(second) else []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(second):
                heapq.heappush(heap, (-(up_a[i] + up_b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(up_a[i + 1] + up_b[0]), i + 1, 0))
            size = int(self.sizes[first[i], second[j]])
            if size:
                yield -bound, low_a[i] + low_b[j], int(self.starts[first[i], second[j]]), size

    def measured(self, anchor: np.ndarray, ceiling: float = float("inf")) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(upper bound of all rows left, places, scores), a batch of cells at a time; cells wholly above ceiling are left out."""
        weights = anchor.astype(self.x.dtype)
        places, scores, n, batch = [], [], 0, BATCH
        for bound, lower, start, size in self.visit(anchor):
            if n >= batch:
                yield bound, np.concatenate(places), np.concatenate(scores).astype(np.int64)
                places, scores, n, batch = [], [], 0, 2 * batch
            if lower <= ceiling:
                places.append(np.arange(start, start + size))
                scores.append(self.x[start : start + size] @ weights)
                n += size
        if places:
            yield float("-inf"), np.concatenate(places), np.concatenate(scores).astype(np.int64)

    def positives(self, anchor: np.ndarray, own: int, label, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best other rows of the label: certified once the k-th is above all that is left."""
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = self.codes.get(label, -1)
        for left, at, s in self.measured(anchor) if code >= 0 else ():
            fits = (self.labels[at] == code) & (self.uids[at] != own)
            places, scores = np.r_[places, at[fits]], np.r_[scores, s[fits]]
            best = best_first(scores, self.ids[places], k)
            places, scores = places[best], scores[best]
            if len(scores) == k and scores[-1] > left:
                break
        return places, scores

    def negatives(self, anchor: np.ndarray, label, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) the places and scores of its k best rows of other labels.

        A window is certified once its k-th row is above all that is left, or all that is left is below it.
        """
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, open_ = [empty] * len(windows), set(range(len(windows)))
        code = self.codes.get(label, -1)
        for left, at, s in self.measured(anchor, max((h for _, h in windows), default=0)):
            other = self.labels[at] != code
            at, s = at[other], s[other]
            for w in list(open_):
                low, high = windows[w]
                floor = found[w][1][-1] if len(found[w][1]) == k else low
                inside = np.flatnonzero((s >= floor) & (s <= high))
                if len(inside):
                    places, scores = np.r_[found[w][0], at[inside]], np.r_[found[w][1], s[inside]]
                    best = best_first(scores, self.ids[places], k)
                    found[w] = places[best], scores[best]
                if left < low or (len(found[w][0]) == k and found[w][1][-1] > left):
                    open_.discard(w)
            if not open_:
                break
        return found


def longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def mine(df: DataFrame, spark: SparkSession, label: Column, anchors: Column, k_positive: int = 5, k_negative: int = 3, window: tuple[int, int] = (50, 95), vec_id: str = "vec_id", vector: str = "embedding", codewords: int = CODEWORDS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of df where `anchors` holds.

    A row's score is its integer inner product with the anchor, components counting as floor(256 * x); higher scores come
    first, ties by vec_id. An anchor's positives are its k_positive best other rows of the same label (all, if fewer).
    For each of them come the k_negative best rows of other labels with window[0] % to window[1] % of its score (all, if
    fewer; a negative positive_score has none).

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part. Shorter vectors count
    as filled up with zeros. Rows that repeat an id are rows of their own, and only the anchor's own row is no positive of
    it. An empty table gives an empty one. Other columns of df play no part.
    """
    scratch = Scratch(spark)
    rows = integer_vectors(df.where(label.isNotNull()), vec_id, vector, scratch, label=label.cast("string"), asks=F.coalesce(anchors, F.lit(False)))
    n, width, most = measures(rows)
    cut = width // 2
    sample = rows.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE_ROWS).select("x").collect()  # a stated bound
    some = np.array([[*r["x"], *[0] * (width - len(r["x"]))] for r in sample], float).reshape(len(sample), width)
    books = (codebook(some[:, :cut], codewords), codebook(some[:, cut:], codewords)) if len(some) else (np.zeros((0, cut)), np.zeros((0, width - cut)))
    queries = rows.where("asks").drop("asks")
    rows = rows.drop("asks")

    def build(x: np.ndarray, columns: pa.Table) -> MultiIndex:
        ids, uids = columns["vec_id"].to_numpy(), columns["uid"].to_numpy()
        return MultiIndex.of(x, ids, uids, np.array(columns["label"].to_pylist(), object), books, most)

    def positives(index: MultiIndex, x: np.ndarray, columns: pa.Table) -> list[np.ndarray]:
        uids = columns["uid"].to_numpy()
        found = [index.positives(*q, k_positive) for q in zip(x, uids, columns["label"].to_pylist())]
        at, scores = (np.concatenate(c) for c in zip(*found))
        return [np.repeat(uids, [len(p) for p, _ in found]), index.ids[at], scores]

    near = at_every_block(rows, queries, width, n, build, positives, longs("anchor", "positive_id", "positive_score"))
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k_positive)
    lists = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    asking = queries.join(lists, queries["uid"] == lists["anchor"]).select("uid", "vec_id", "x", "label", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"))
    asking = scratch.table(asking)

    def negatives(index: MultiIndex, x: np.ndarray, columns: pa.Table) -> list[np.ndarray]:
        out = [[np.zeros(0, np.int64)] for _ in range(7)]
        names = ("uid", "vec_id", "label", "positive_ids", "positive_scores")
        for a, uid, vec, own, ids, scores in zip(x, *(columns[c].to_pylist() for c in names)):
            # 100 * score between window[0] and window[1] times the positive's
            windows = [(-(-window[0] * s // 100), window[1] * s // 100) for s in scores]
            open_ = [i for i, (low, high) in enumerate(windows) if low <= high]
            for i, (at, found) in zip(open_, index.negatives(a, own, [windows[i] for i in open_], k_negative)):
                some = np.full(len(at), 1)
                for column, values in zip(out, (some * uid, some * vec, some * (i + 1), some * ids[i], some * scores[i], index.ids[at], found)):
                    column.append(values)
        return [np.concatenate(c) for c in out]

    schema = longs("anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")
    hard = at_every_block(rows, asking, width, n, build, negatives, schema)
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k_negative)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
