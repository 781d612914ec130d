"""The Jaccard join against all pairs, and the stages of the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm import parity_join
from tests.llm.conftest import DOCS, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = (text or "").encode().split()
    w = [x.decode().translate(LOWER) for x in w]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k, num, den):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed):
    """Chains and groups of near copies at all distances, a passage that all share, short texts, exact copies."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(4000))
    rows, n = [], 0
    common = " ".join(word() for _ in range(40))
    for size in (3, 5, 6, 7, 8, 12, 20, 33, 50, 90, 160, 400):
        for _ in range(3):
            text = [word() for _ in range(size)]
            if r.random() < 0.4:
                text = common.split() + text
            for _ in range(r.randrange(1, 14)):
                rows.append((n, " ".join(text)))
                n += 1
                for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                    at = r.randrange(len(text))
                    if r.random() < 0.3 and len(text) > 2:
                        del text[at]
                    else:
                        text[at] = word()
    return rows + [(n, ""), (n + 1, None), (n + 2, " \n"), (n + 3, rows[0][1].upper()), (n + 4, "x"), (n + 5, "X")]


@pytest.mark.parametrize(("k", "num", "block", "seed"), [(4, 85, 512, 1), (5, 80, 4, 2), (2, 50, 3, 3)])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, k, num, block, seed):
    monkeypatch.setattr(parity_join, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = parity_join.near_duplicates(df.withColumn("cls", F.lit("clash")), spark, parity_join.Similarity(k=k, num=num))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == components(rows, k, num, 100)


def edited(words, r, n):
    """Some words replaced, removed or put in."""
    words = list(words)
    for _ in range(n):
        at, how = r.randrange(len(words)), r.randrange(3)
        words[at : at + (how > 0)] = [] if how == 1 and len(words) > 1 else [f"new{r.randrange(10**9)}"]
    return words


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_no_link_of_short_texts_is_lost(spark, k, num):
    """Thousands of pairs that differ by appended words, and by edits anywhere: the few common pieces may be empty ones."""
    r = random.Random(num)
    texts, pairs = [], []
    for size in range(3, 24):
        for more in (1, 2, 3):
            for _ in range(60):
                words = [f"w{r.randrange(10**9)}" for _ in range(size + k - 1)]
                pairs.append((words, words + [f"w{r.randrange(10**9)}" for _ in range(more)]))
    for _ in range(1500):
        words = [f"w{r.randrange(10**9)}" for _ in range(r.randrange(8, 60))]
        pairs.append((words, edited(words, r, r.randrange(1, 4))))
    for a, b in pairs:
        texts += [(len(texts), " ".join(a)), (len(texts) + 1, " ".join(b))]
    out = parity_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), spark, parity_join.Similarity(k=k, num=num))
    got = {x["doc_id"]: x["component_id"] for x in out.collect()}
    linked = 0
    for i in range(0, len(texts), 2):
        a, b = (shingles(t, k) for _, t in texts[i : i + 2])
        alike = 100 * len(a & b) >= num * len(a | b)
        linked += alike
        assert (got[i], got[i + 1]) == ((i, i) if alike else (i, i + 1)), texts[i : i + 2]
    assert linked >= 2000


def test_sketches_bound_the_difference():
    r = np.random.default_rng(0)
    for n in (5, 50, 900):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[a[n // 10 :], r.integers(0, 1 << 63, n // 8 + 1).astype(np.uint64)])
        apart = int(np.bitwise_count((parity_join.sketch(a) ^ parity_join.sketch(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_odd_rows(spark, docs):
    out = parity_join.near_duplicates(docs, spark).collect()
    assert len(out) == docs.count()
    got = {(r["doc_id"], r["component_id"]) for r in out}
    assert {(1, 1), (2, 1), (3, 3), (4, 4), (7, 7), (None, None)} <= got
    assert parity_join.near_duplicates(docs.limit(0), spark).count() == 0


def test_rows_that_repeat_id_and_text(spark):
    """One row of those stays, with all its columns; ids that share no text stay, and copies under other ids go."""
    rows = [(1, prose(1), f"s{i % 3}") for i in range(500)] + [(1, prose(2), "x"), (2, prose(1), "y"), (3, "", "z"), (3, "", "z"), (None, prose(3), "n"), (None, prose(3), "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string").repartition(3)
    got = parity_join.one_of_each_group(df, spark).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "uid"}
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, prose(1)), (1, prose(2)), (3, ""), (3, ""), (0, prose(3))])


def test_pipeline(spark, tmp_path):
    rows = [(i, prose(i, 40 + i % 50) + f" item {i} of row {i * 17 % 101}", "en", f"s{i % 4}", 1) for i in range(240)]
    rows += [(500 + i, rows[i][1], "en", "s1", 1) for i in range(10)]  # exact copies
    rows += [(600 + i, "$$$ BUY!! now### " * 12 + prose(i, 8), "en", "s2", 1) for i in range(40)]  # junk
    rows += [(700, "", "en", "s0", 0), (701, None, None, None, None), (702, "short one", "en", "s0", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 240, 2)] + [(600 + i, 0, 0) for i in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    assert not {700, 701, 702} & set(seen[0]) and not [i for i in seen[1] if 600 <= i < 640]
    assert set(range(240)) & set(seen[0]) == set(range(240)) & set(seen[1])
    assert not [i for i in seen[2] if 500 <= i < 510] and len(seen[2]) == len(set(seen[2]))
    assert set(seen[3]) <= set(seen[2]) and sorted(seen[4]) == sorted(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])
