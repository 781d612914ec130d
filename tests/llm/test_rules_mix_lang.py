"""Quality rules and the source mix against plain Python, language masks and the classifier on held-out rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm import langmask, mixing, ngram_rules, pu_quality
from assay.llm.common import Scratch
from tests.llm.conftest import DOCS, prose

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, docs):
    more = [(20, "a b c d e f a b c d e\nx y\nx y", None, None, 1), (21, "w " * 30, None, None, 1), (22, "1 2 3 4 5 6 7 8 9 10 11 12", None, None, 1), (23, "\n".join(["same line here"] * 3), None, None, 1)]
    rows = docs.union(spark.createDataFrame(more, DOCS)).withColumn("n_words", F.lit("clash"))
    for r in ngram_rules.base_statistics(rows).collect():
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == base(r["text"]), r["doc_id"]
        assert r["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0])


def test_log_ratios(spark, docs):
    trusted = spark.createDataFrame([(1,), (10,), (None,)], "doc_id long")
    b = 64
    ratios = ngram_rules.fit_log_ratios(docs, trusted, b)
    h64 = lambda raw: xxhash.xxh64_intdigest(raw, 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def buckets(text):
        tokens = re.findall(r"[^\W_]+|(?:_|[^\w\s])+", text or "")
        h = [h64(t.encode()) for t in tokens]
        pairs = [xxhash.xxh64_intdigest(y.to_bytes(8, "little"), x) for x, y in zip([h64(a.to_bytes(8, "little")) for a in h], h[1:])]
        return [signed(x) % 32 for x in h] + [signed(x) % 32 + 32 for x in pairs]

    raw, target = Counter(), Counter()
    for r in docs.collect():
        raw.update(buckets(r["text"]))
        if r["doc_id"] in (1, 10):
            target.update(buckets(r["text"]))
    n, m = sum(raw.values()) + b, sum(target.values()) + b
    for i in range(b):
        p = (raw[i] + 1) / n
        assert math.isclose(ratios[i], math.log((target[i] + b * p) / m) - math.log(p), abs_tol=1e-9)
    kept = {r["doc_id"]: r for r in ngram_rules.apply_rules(docs, trusted, buckets=b).collect()}
    want = buckets(kept[1]["text"])
    assert math.isclose(kept[1]["log_ratio"], sum(ratios[i] for i in want) / len(want), abs_tol=1e-5)
    assert kept[4]["log_ratio"] == 0.0 and not kept[4]["kept"]
    none = ngram_rules.apply_rules(docs, trusted.limit(0), buckets=b)
    assert none.where(F.abs("log_ratio") > 1e-6).isEmpty()
    assert ngram_rules.apply_rules(docs.limit(0), trusted, buckets=b).count() == 0


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mix(spark):
    rows = [(i, prose(i % 37, 20 + i % 90), "en", s, 1) for i, s in enumerate((["big"] * 300 + ["mid"] * 60 + ["a"] * 5 + [None] * 40 + ["z"] * 2) * 2)]
    rows += [(7000, None, "en", "a", 0), (7001, "", "en", "empty", 0), (None, prose(3), "en", "mid", 1), rows[0], rows[0]]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, spark, shard_words=4000).cache()
    per = defaultdict(int)
    for r in rows:
        per[r[3]] += len((r[1] or "").split())
    want = targets(per)
    taken = defaultdict(int)
    for r in got.collect():
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == per[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in per) and got.count() == len(rows)
    again = mixing.mix(df.repartition(7), spark, shard_words=4000)
    assert again.exceptAll(got).isEmpty()
    drawn = mixing.draw(df, spark, shard_words=4000).cache()
    words = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).alias("n")).collect()}
    assert all(abs(words.get(s, 0) - want[s]) <= 1 for s in per)
    assert drawn.select("shard").distinct().count() > 3 and mixing.mix(df.limit(0), spark).count() == 0


def test_mix_of_entire_texts(spark):
    many = [(i, "\n".join([prose(i, 20 + i % 90)] * 2), "en", f"m{i % 4}", 1) for i in range(400)]
    rows = [*many, *((1000 + i, prose(i, 40), "en", f"one{i:03d}", 1) for i in range(60)), (2000, "", "en", "empty", 0)]
    df = spark.createDataFrame(rows, DOCS)
    per, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(r[1].split())
        per[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
    want, given = targets(per), Counter((r[0], r[1]) for r in rows)
    got = corpus_pipeline.source_mix(spark, df, "").collect()
    for r in got:
        assert (r["doc_id"], r["text"]) in given
        taken[r["source"]] += len(r["text"].split())
    assert max(Counter(r["doc_id"] for r in got).values()) <= 3
    for s, n in per.items():
        assert abs(taken[s] - want[s]) <= largest[s] * (1 if s.startswith("one") else 0.5) + 1
        assert taken[s] > 0 or n == 0
    again = mixing.draw(df.repartition(7), spark, shard_words=4000, blocks=16, entire=True).collect()
    assert {(r["doc_id"], r["text"]) for r in again} <= set(given)


def test_mix_with_clashing_names(spark, docs):
    names = ["size", "h", "block", "quota", "target", "words", "copy", "extra", "part", "shards", "a.b"]
    clash = docs.withColumns({c: F.concat(F.lit(f"{c}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in names}).withColumn("shard", F.lit("old"))
    drawn = mixing.draw(clash, spark)
    assert drawn.columns == [*docs.columns, *names, "shard"]
    got = drawn.collect()
    assert got and all(r[c] == f"{c}/{'' if r['doc_id'] is None else r['doc_id']}" for r in got for c in names)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in mixing.draw(docs, spark).collect())
    assert mixing.mix(clash, spark).exceptAll(mixing.mix(docs, spark)).isEmpty()
    assert mixing.draw(clash.limit(0), spark).count() == 0


def test_targets_of_many_sources(spark):
    """Sizes from one word to millions, equal ones, empty ones and a null source; names beyond the basic plane."""
    draws = random.Random(5)
    sizes = {f"{draws.choice(['s', 'S', chr(0xE9), chr(0x1F600), chr(0xFFFD)])}{i}": int(1.03 ** draws.randrange(500)) * (i % 9 > 0) for i in range(1500)}
    sizes[None] = 12_345
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()] * 2, "source string, size long").repartition(6)
    per, n_sources, words = mixing.source_targets(df, Scratch(spark))
    want = targets({s: 2 * n for s, n in sizes.items()})
    got = {r["source"]: r for r in per.collect()}
    assert n_sources == len(got) == len(sizes) and words == 2 * sum(sizes.values())
    for s, r in got.items():
        assert math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9) and r["n_docs"] == 2
        assert r["source_size"] == 2 * sizes[s] and abs(r["quota"] - want[s]) <= 0.5 + 1e-6 and r["quota"] <= 3 * r["source_size"]
    assert math.isclose(sum(r["target"] for r in got.values()), words, rel_tol=1e-9)
    for none in (df.limit(0), df.withColumn("size", F.lit(0).cast("long"))):
        per, _, words = mixing.source_targets(none, Scratch(spark))
        assert words == 0 and per.where("target <> 0 or quota <> 0").isEmpty()


def test_shard_quotas_are_exact(spark):
    drawn = spark.range(500).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, None).otherwise("b").alias("source"))
    q = mixing.shard_quotas(drawn, 6, 1).collect()
    want = Counter(r["source"] for r in drawn.collect())
    for s in want:
        mine = sorted((r["shard"], r["offset"], r["n"]) for r in q if r["source"] == s)
        assert sum(n for _, _, n in mine) == want[s] and all(a[1] + a[2] == b[1] for a, b in zip(mine, mine[1:]))
    by = Counter()
    for r in q:
        by[r["shard"]] += r["n"]
    assert len(by) == 6 and max(by.values()) - min(by.values()) <= 3


LANGS = {"aa": "kato miru sona teka nori", "bb": "blench struft krind spolt grumf", "cc": "привет мир кот лес"}


def test_languages(spark):
    rng = np.random.default_rng(1)
    rows = [(" ".join(rng.choice(LANGS[k].split(), 12)), k) for k in LANGS for _ in range(30)]
    fitted = langmask.fit(spark.createDataFrame([*rows, (None, "aa"), ("x", None), ("", "bb")], "text string, lang string"), spark)
    test = [("kato kato miru", "aa"), ("Struft KRIND 12", "bb"), ("КОТ лес", "cc"), (None, "und"), ("", "und"), ("12 $$ 7", "und"), ("kato " * 50_000, "aa")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(test)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    for r in langmask.identify(df, fitted).collect():
        assert r["lang_pred"] == test[r["doc_id"]][1] and 0 <= r["score"] <= 1
    nothing = langmask.fit(spark.createDataFrame([], "text string, lang string"), spark)
    assert {r["lang_pred"] for r in langmask.identify(df, nothing).collect()} == {"und"}


def test_many_languages_and_trigrams(spark):
    rows = [(f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i)}{chr(0x5000 + i)}{chr(0x5000 + i)}", f"l{i:03d}") for i in range(70)]  # more than one plane
    fitted = langmask.fit(spark.createDataFrame(rows, "text string, lang string"), spark)
    assert fitted.planes.shape[0] == 2 and fitted.classify([t for t, _ in rows])[0] == [k for _, k in rows]
    codes, counts = langmask.trigrams(["Ab, c", None, "", "z"])
    text = lambda c: "".join(chr(int(c) >> s & 0x1FFFFF) for s in (42, 21, 0))
    assert [text(c) for c in codes] == [" ab", "ab ", " c ", " z "] and counts.tolist() == [3, 0, 0, 1]


def test_classifier(spark):
    rows = []
    for i in range(600):
        bad = i % 6 == 0
        text = " ".join(f"{w}$$$" if k % 2 else w.upper() for k, w in enumerate(prose(i).split())) if bad else prose(i, 30 + i % 80)
        rows.append((i, text, bad))
    rows += [(9000, None, True), (9001, "", True), (None, prose(3), False), (1, rows[1][1], False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bad boolean")
    good = df.where("not bad and doc_id % 3 = 0").select("doc_id")
    out = pu_quality.score_texts(df.withColumn("score", F.lit("clash")), good, F.col("doc_id") % 5 != 0, spark).cache()
    assert out.count() == len(rows) and out.where("score < 0 or score > 1 or score is null").isEmpty()
    held = out.join(df.select("doc_id", "bad").distinct(), "doc_id").where("doc_id % 5 = 0 and doc_id < 9000")
    assert held.where("bad and predicted = 1").isEmpty() and held.where("not bad and predicted = 0").isEmpty()
    assert {r["score"] for r in pu_quality.score_texts(df, good.limit(0), F.lit(True), spark).collect()} == {0.5}
    assert pu_quality.score_texts(df.limit(0), good, F.lit(True), spark).count() == 0


def test_prior():
    p, u = np.zeros(100), np.zeros(100)
    p[60:] = 1000
    u[60:], u[:40] = 700, 450
    assert abs(pu_quality.estimate_prior(p, u) - 28000 / 46000) < 0.03


def plain_risk(x, positive, w, prior, penalty):
    f = x @ w
    soft = lambda v: np.logaddexp(0, v).mean()
    return prior * soft(-f[positive]) + max(0.0, soft(f) - prior * soft(f[positive])) + 0.5 * penalty * (w[:-1] ** 2).sum()


def test_descends_the_non_negative_risk(spark):
    """A prior that is too large makes the risk of the unlabelled rows negative: there the gradient of the positives alone
    counts. The fit is compared with long subgradient descent on the same risk, all rows at once."""
    rng = np.random.default_rng(3)
    raw = rng.normal(size=(400, pu_quality.FEATURES)).astype(np.float32)
    positive = (raw[:, 0] > 0.3) & (rng.random(400) < 0.5)
    raw[positive, 1] += 1
    df = spark.createDataFrame([([float(v) for v in r], bool(p)) for r, p in zip(raw, positive)], "x array<float>, positive boolean").repartition(3)
    for prior in (0.3, 0.97):
        old, pu_quality.estimate_prior = pu_quality.estimate_prior, lambda *_, p=prior: p
        try:
            model = pu_quality.fit(df, steps=12)
        finally:
            pu_quality.estimate_prior = old
        e = pu_quality.expand(raw.astype(float), model.mean, model.scale)
        penalty = 1e-3 + 4 / positive.sum()
        w = np.zeros(e.shape[1])
        w[-1] = math.log(prior / (1 - prior))
        best = plain_risk(e, positive, w, prior, penalty)
        clamped = 0
        for t in range(6000):
            f, ep = e @ w, e[positive]
            s, q = 1 / (1 + np.exp(-f)), 1 / (1 + np.exp(-f[positive]))
            g = prior * ((q - 1)[:, None] * ep).mean(0)
            if np.logaddexp(0, f).mean() > prior * np.logaddexp(0, f[positive]).mean():
                g += (s[:, None] * e).mean(0) - prior * (q[:, None] * ep).mean(0)
            else:
                clamped += 1
            w = w - 0.5 / math.sqrt(1 + t / 20) * (g + penalty * np.r_[w[:-1], 0])
            best = min(best, plain_risk(e, positive, w, prior, penalty))
        assert plain_risk(e, positive, model.weights, prior, penalty) <= best + 2e-3
        assert clamped > 0 or prior == 0.3


def test_features_and_scores_of_whole_texts(spark, docs):
    for words in ([], [b"a"], [b"a", b"a"], [b"a", b"b", b"a", b"b", b"a"], [b"%d" % (i * i % 7) for i in range(50)]):
        pairs, triples = list(zip(words, words[1:])), list(zip(words, words[1:], words[2:]))
        assert not words or pu_quality.variety(words) == (len(set(words)), len(set(pairs)), len(set(triples)), sum(a == b for a, b in pairs))
    rng = np.random.default_rng(0)
    size = pu_quality.FEATURES
    model = pu_quality.Model(rng.normal(size=size), rng.random(size) + 0.1, rng.normal(size=3 * size + 1), 0.5)
    x = rng.normal(size=(20, size)).astype(np.float32) * 3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, x array<float>")
    got = [r["s"] for r in df.select("i", pu_quality.score_of(F.col("x"), model).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, model.score(x.astype(float)), atol=1e-9)
    clash = docs.withColumns({"others": F.lit(1), "x": F.lit(2), "may_train": F.lit("c"), "score": F.lit("s"), "a.b": F.lit(3)})
    kept = pu_quality.keep_good(clash, docs.where("doc_id = 1").select("doc_id"), F.lit(True), spark, threshold=0.0)
    assert kept.columns == clash.columns and kept.count() == docs.count() and kept.where("score <> 's' or may_train <> 'c'").isEmpty()
