"""Bit-sliced top-k search and hard negatives against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import bit_sliced_topk, hard_negatives, queries, vector_blocks

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, x int, asks string, block int"


def whole(v):
    """The vector as integers, None where it takes no part."""
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)


def dot(a, b):
    n = min(len(a), len(b))
    return int(a[:n] @ b[:n])


def plain_top(rows, k=5):
    rows = [(i, x) for i, v, *_ in rows if i is not None and (x := whole(v)) is not None]
    out = []
    for n, (i, a) in enumerate(rows):
        if i % 50 == 0:
            found = sorted((-dot(a, b), j) for m, (j, b) in enumerate(rows) if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def plain_negatives(rows):
    rows = [(i, x, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab, *_ in rows if i is not None and lab is not None and (x := whole(v)) is not None]
    out = []
    for n, (i, a, lab) in enumerate(rows):
        if i % 50 == 0:
            scored = [(dot(a, b), j, own) for m, (j, b, own) in enumerate(rows) if m != n]
            for p, pid, _ in sorted((s for s in scored if s[2] == lab), key=lambda s: (-s[0], s[1]))[:5]:
                fits = sorted((-s, j) for s, j, own in scored if own != lab and 50 * p <= 100 * s <= 95 * p)[:3]
                out += [(i, pid, r, j, p, -s) for r, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def table(seed, n=900):
    """Clusters, one vector many times over, ties, repeated rows, odd vectors of every kind."""
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.3, (12, 10))
    rows = [(i, (centres[i % 12] + r.normal(0, 0.05, 10)).tolist(), int(i % 12 % 10)) for i in range(n)]
    rows += [(1000 + i, centres[0].tolist(), int(i % 3)) for i in range(300)]
    rows += [(2000 + i, [float(c) for c in r.integers(-2, 3, 10) / 4], 4) for i in range(101)]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None, 1), (3050, [nan] * 10, 1), (3100, [inf, *[0.0] * 9], 1), (3150, [None, *[0.5] * 9], 1), (3200, [], 1), (3250, [0.0] * 10, None), (3300, [1.0, 2.0], 2)]
    rows += [(None, [0.5] * 10, 1), (50, rows[50][1], rows[50][2]), (51, rows[51][1], rows[51][2]), (3350, [0.0] * 10, 3), (3400, [-0.7] * 10, 3)]
    return [(*row, "clash", 7, "clash", 3) for row in rows]


@pytest.mark.parametrize(("seed", "rows_a_block"), [(1, 16384), (2, 150)])
def test_registered_queries_equal_brute_force(spark, tmp_path, monkeypatch, seed, rows_a_block):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", rows_a_block)
    rows = table(seed)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_bit_sliced_topk(spark, str(tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top(rows)
    got = queries.op11_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # of rows that repeat an id, either may be named first
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_few_and_no_rows(spark, tmp_path):
    for n in (0, 1, 3):
        spark.createDataFrame(table(3)[:n], SCHEMA).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        assert queries.op13_bit_sliced_topk(spark, f"{tmp_path}/{n}").count() == max(0, n - 1)
        assert queries.op11_hard_negatives(spark, f"{tmp_path}/{n}").count() <= n
    with pytest.raises(ValueError, match="too large"):
        bit_sliced_topk.top_k(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], "vec_id long, embedding array<double>, label int"), spark, F.lit(True))


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame(table(4), SCHEMA)
    assert bit_sliced_topk.top_k(df, spark, F.col("vec_id") == 7, k=2).count() == 2
    assert hard_negatives.mine(df, spark, F.col("label"), F.col("vec_id") == 7).count() <= 15


@pytest.mark.parametrize(("low", "high"), [(-5, 6), (0, 1), (-40_000, 90_000), (3, 4)])
def test_bit_slices_add_up(low, high):
    r = np.random.default_rng(high)
    x, w = r.integers(low, high, (130, 9)), r.integers(-200, 200, (7, 9))
    w[3] = 0
    index = bit_sliced_topk.BitSlicedIndex.of(x, np.arange(130), np.arange(130))
    part = (x - index.low) >> index.shift
    for q, bits in enumerate(np.swapaxes(index.sums(w), 0, 1)):
        value = np.zeros(130, np.int64)
        for power, b in enumerate(bits):
            value[np.intersect1d(bit_sliced_topk.places(b), np.arange(130))] += 1 << power
        assert len(set((value - part @ w[q]).tolist())) == 1  # but for a constant


def test_clustered_rows_are_pruned_and_order_is_kept():
    """Cells come by falling bounds that hold for their rows, and certified windows leave most cells out."""
    r = np.random.default_rng(5)
    centres = r.normal(0, 300, (40, 16))
    x = np.floor(centres[np.arange(8000) % 40] + r.normal(0, 4, (8000, 16))).astype(np.int64)
    books = tuple(hard_negatives.codebook(h.astype(float), 40) for h in (x[:2000, :8], x[:2000, 8:]))
    index = hard_negatives.MultiIndex.of(x, np.arange(8000), np.arange(8000), np.array([str(i % 40) for i in range(8000)], object), books, 3000)
    seen = []
    for i in range(0, 400, 37):
        bounds = list(index.visit(x[i]))
        assert [b[0] for b in bounds] == sorted((b[0] for b in bounds), reverse=True) and sum(b[3] for b in bounds) == 8000
        for upper, lower, start, size in bounds:
            scores = index.x[start : start + size] @ x[i]
            assert lower <= scores.min() and scores.max() <= upper
        read = []
        measured = index.measured
        index.measured = lambda *a: (read.append(len(m[1])) or m for m in measured(*a))
        at, scores = index.positives(x[i], i, str(i % 40), 5)
        del index.measured
        same = np.flatnonzero((np.arange(8000) % 40 == i % 40) & (np.arange(8000) != i))
        want = same[np.lexsort((same, -(x[same] @ x[i])))[:5]]
        assert index.ids[at].tolist() == want.tolist()
        seen.append(sum(read))
    assert np.mean(seen) < 0.2 * 8000
