"""Rankings known by counts alone, and the hash tree, against plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import metrics, selection
from assay.plans import provenance


def plain(rows, k):
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    return {r[0] for r in order[:k]}, sum(r[2] for r in order[:k])


@pytest.mark.parametrize(("few_scores", "few"), [(65_536, 20_000), (3, 4)])
def test_places_equal_those_of_a_sort(spark, monkeypatch, few_scores, few):
    monkeypatch.setattr(metrics, "FEW_SCORES", few_scores)
    monkeypatch.setattr(selection, "FEW", few)
    r = random.Random(1)
    rows = [(i, r.choice([float(r.randrange(5)), 2.0, r.random()]), r.random() < 0.3, r.choice("ab")) for i in r.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "source_index long, score double, truth boolean, label string").repartition(3)
    ranking = metrics.Ranking(df)
    assert (ranking.n, ranking.positives) == (400, sum(x[2] for x in rows))
    for k in (1, 37, 150, 400, 999):
        first, hits = plain(rows, k)
        assert ranking.hits(k) == hits
        assert {x["source_index"] for x in ranking.rows.where(ranking.cut(k)).collect()} == first
    pairs = [(a[1] > b[1]) + (a[1] == b[1]) / 2 for a in rows if a[2] for b in rows if not b[2]]
    assert abs(ranking.auroc() - sum(pairs) / len(pairs)) < 1e-12
    by = {x["label"]: x for x in metrics.review_by_class(df, 0.1).collect()}
    for c in "ab":
        own = [x for x in rows if x[3] == c and x[0] in plain(rows, 40)[0]]
        assert (by[c]["n_reviewed"], by[c]["true_positives"]) == (len(own), sum(x[2] for x in own))


def test_odd_scores_and_no_rows(spark):
    rows = [(0, None, True), (1, math.nan, False), (2, math.inf, True), (3, 1.0, False), (4, -math.inf, False)]
    ranking = metrics.Ranking(spark.createDataFrame(rows, "source_index long, score double, truth boolean"))
    first = lambda k: {x["source_index"] for x in ranking.rows.where(ranking.cut(k)).collect()}
    assert [first(k) for k in (1, 2, 3, 4)] == [{1}, {1, 2}, {1, 2, 3}, {0, 1, 2, 3}]
    none = spark.createDataFrame([], "source_index long, score double, truth boolean, label string")
    r = metrics.ranking_report(none).first()
    assert (r["n"], r["k"], r["precision_at_k"]) == (0, 0, 0.0) and math.isnan(r["auroc"])
    assert metrics.review_budget(none).first()["n_reviewed"] == 0 and metrics.review_by_class(none).count() == 0


@pytest.mark.parametrize(("n", "fan_in"), [(0, 3), (1, 3), (50, 3), (50, 1000)])
def test_hash_tree(spark, n, fan_in):
    rows = [(i, None if i % 7 == 0 else f"v{i}", i / 3) for i in range(n) if i % 11]  # stretches with gaps
    df = spark.createDataFrame(rows, "source_index long, a string, b double")
    hashed = {r["source_index"]: r["h"] for r in df.select("source_index", provenance.row_hash(["a", "b"]).alias("h")).collect()}
    top = max(hashed, default=0)
    while True:
        groups = {}
        for i in sorted(hashed):
            groups.setdefault(i // fan_in, []).append(hashed[i])
        assert all(len(g) <= fan_in for g in groups.values())
        hashed = {g: hashlib.sha256("\n".join(h).encode()).hexdigest() for g, h in groups.items()}
        top //= fan_in
        if not top:
            break
    want = hashlib.sha256(("a,b\n" + "".join(hashed.values())).encode()).hexdigest()
    assert provenance.content_hash(df.repartition(3), fan_in=fan_in).first()[0] == want
    if n:
        changed = df.withColumn("b", F.when(F.col("source_index") == top, F.col("b")).otherwise(F.col("b") + 1))
        assert n < 5 or provenance.content_hash(changed, fan_in=fan_in).first()[0] != want
