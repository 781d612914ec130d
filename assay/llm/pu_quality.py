"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Positives are trusted texts, the unlabelled texts are all of the training side. The share of positives among
the unlabelled is estimated first (the least ratio of the tails of a positive-against-unlabelled score); then
a logistic model minimises  pi E_p[l(f)] + max(0, E_u[l(-f)] - pi E_p[l(-f)])  by Newton steps whose lengths are
chosen by that risk itself. Sums run as Spark jobs over all rows; only sums over features come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import map_column, materialise, mix64

CLASSES = [b"#*$%&|<>", b"!?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"\n", b"\t ", b"()[]{}\"'`", b"/\\@_=+~^"]
FEATURES = len(CLASSES) + 14
BINS = 400


def variety(words: list[bytes]) -> tuple[int, int, int, int]:
    """Numbers of distinct words, pairs and triples of neighbouring words, and of words that equal the next one.

    Words and pairs are numbered, so that a word of a long text takes some machine words and not a tuple.
    """
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs, which = np.unique(at[:-1] * len(number) + at[1:], return_inverse=True)
    triples = np.unique(which[:-1] * len(number) + at[2:]) if len(at) > 2 else at[:0]
    return len(number), len(pairs), len(triples), int((at[1:] == at[:-1]).sum())


def features(text: str | None) -> np.ndarray:
    """Shape of a text: shares of byte classes, words, repetition, lines, and how well it compresses."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(FEATURES)
    if not raw:
        return out
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    k = len(CLASSES)
    out[:k] = [hist[list(c)].sum() / len(raw) for c in CLASSES]
    out[k] = hist[128:].sum() / len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    out[k + 1] = np.log1p(n)
    if n:
        lengths = np.fromiter(map(len, words), np.int64, n)
        out[k + 2], out[k + 3] = lengths.mean(), lengths.std()
        one, two, three, same = variety(words)
        out[k + 4], out[k + 5], out[k + 6], out[k + 7] = one / n, two / max(1, n - 1), three / max(1, n - 2), same / n
        out[k + 8] = sum(map(bytes.isupper, words)) / n
        out[k + 9] = sum(map(bytes.isalpha, words)) / n
    if lines:
        out[k + 10], out[k + 11] = len(set(lines)) / len(lines), np.log1p(n / len(lines))
    out[k + 12] = min(4.0, len(zlib.compress(raw, 1)) / len(raw))
    out[k + 13] = np.log1p(len(raw))
    return out


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by x, the features of the whole text (zeros for a null or empty one)."""

    def make():
        def kernel(texts):
            x = np.concatenate([features(t) for t in texts.to_pylist()]).astype(np.float32)
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * FEATURES), pa.array(x))]

        return kernel

    return map_column(df, text, make, [T.StructField("x", T.ArrayType(T.FloatType()))], drop=(text,))


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, their parts beyond one deviation on either side, and a constant."""
    z = ((x - mean) / scale).clip(-8, 8)
    return np.concatenate([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0), np.ones((len(z), 1))], axis=1)


def sums(train: DataFrame, body: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows (x, positive) of body(x, positive), a vector: summed within tasks, then by position."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = body(b.column(0).flatten().to_numpy().reshape(b.num_rows, FEATURES).astype(np.float64), b.column(1).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    rows = train.select("x", "positive").mapInArrow(run, schema).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    return rows["v"].to_numpy()


def half(x: np.ndarray) -> np.ndarray:
    """Which rows are of the first half: equal rows fall alike."""
    return mix64(np.floor(x.sum(axis=1) * 4096).astype(np.int64).view(np.uint64)) & np.uint64(1) == 0


def softplus(f: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, f)


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -60, 60)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(expand(x, self.mean, self.scale) @ self.weights)


def estimate_prior(hist_p: np.ndarray, hist_u: np.ndarray, delta: float = 0.1) -> float:
    """The least ratio of unlabelled to positive tails above a score, each with its sampling error."""
    n_p, n_u = hist_p.sum(), hist_u.sum()
    tail_p, tail_u = np.cumsum(hist_p[::-1]) / n_p, np.cumsum(hist_u[::-1]) / n_u
    slack = np.sqrt(np.log(4 / delta) / (2 * n_u)) + np.sqrt(np.log(4 / delta) / (2 * n_p))
    ok = tail_p > 0
    at = np.argmin((tail_u[ok] + slack) / tail_p[ok])
    return float(np.clip(tail_u[ok][at] / tail_p[ok][at], 0.01, 0.99))


def fit(train: DataFrame, ridge: float = 1e-3, steps: int = 6) -> Model | None:
    """Fit on all rows (x, positive) of train; None if there are no positives.

    The penalty has a part that falls with the number of positives: a few of them say little about rare shapes.
    The score behind the estimate of the prior is fitted on one half of the rows, by a hash of their features,
    and its tails are counted on the other half.
    """
    size = FEATURES

    def moments(x, positive):
        return np.concatenate([[len(x), positive.sum()], x.sum(0), (x * x).sum(0)])

    m = sums(train, moments)
    if not len(m) or m[1] == 0:
        return None
    n, n_p, mean = m[0], m[1], m[2 : 2 + size] / m[0]
    scale = np.sqrt(np.maximum(m[2 + size :] / n - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    d = 3 * size + 1
    upper = np.triu_indices(d)
    penalty = np.r_[np.full(d - 1, ridge + 4 / n_p), 0.0]

    def parts(w: np.ndarray, only_half: bool) -> dict[str, np.ndarray]:
        """Means over unlabelled (u) and positive (p) rows at w: l(-f), gradient of l(-f) and of l(f), and Hessian."""

        def body(x, positive):
            if only_half:
                x, positive = x[half(x)], positive[half(x)]
            e = expand(x, mean, scale)
            f = e @ w
            p = sigmoid(f)
            q, trusted = p[positive], e[positive]
            return np.concatenate(
                [
                    [len(x), len(q), softplus(f).sum(), softplus(f[positive]).sum()], (e * p[:, None]).sum(0), trusted.sum(0), (trusted * q[:, None]).sum(0),
                    ((e * (p * (1 - p))[:, None]).T @ e)[upper], ((trusted * (q * (1 - q))[:, None]).T @ trusted)[upper],
                ]
            )

        s = sums(train, body)
        rows, positives = max(s[0], 1), max(s[1], 1)
        at = np.cumsum([4, d, d, d, len(upper[0])])
        g_u, e_p, g_p, h_u, h_p = np.split(s, at)[1:]
        return {
            "l_u": s[2] / rows, "l_p": s[3] / positives, "g_u": g_u / rows, "g_p": g_p / positives,
            "g_pos": (g_p - e_p) / positives, "h_u": whole(h_u) / rows, "h_p": whole(h_p) / positives,
        }

    def whole(half_matrix: np.ndarray) -> np.ndarray:
        full = np.zeros((d, d))
        full[upper] = half_matrix
        return full + full.T - np.diag(np.diag(full))

    def step(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
        return np.linalg.solve(hessian + np.diag(penalty + 1e-8), gradient + penalty * w)

    def directions(w: np.ndarray, prior: float) -> np.ndarray:
        """Newton steps of the non-negative risk, the larger of two convex functions: prior E_p[l(f)] alone, which holds
        where E_u[l(-f)] - prior E_p[l(-f)] is below 0, and their sum, which holds elsewhere. The first step is that of
        the function that is larger at w. Where it would cross the kink, the minimum may lie on it: there a mixture of
        both gradients counts, with the share that makes the quadratic models of both functions meet at its step."""
        m = parts(w, False)
        negative = m["l_u"] - prior * m["l_p"]
        g_neg, h_neg = m["g_u"] - prior * m["g_p"], m["h_u"] - prior * m["h_p"]

        def mixed(c: float) -> np.ndarray:
            # the Hessians of prior l(f) and prior l(-f) are alike
            return step(w, prior * m["g_pos"] + c * g_neg, prior * m["h_p"] + c * h_neg)

        own, low, high = float(negative >= 0), 0.0, 1.0
        for _ in range(20):
            c = (low + high) / 2
            d = -mixed(c)
            after = negative + g_neg @ d + 0.5 * d @ h_neg @ d
            low, high = (c, high) if after > 0 else (low, c)
        return np.column_stack([mixed(c) for c in (own, 1 - own, low, max(0.0, low - 0.05), min(1.0, low + 0.05))])

    def risks(candidates: np.ndarray, prior: float) -> np.ndarray:
        def body(x, positive):
            f = expand(x, mean, scale) @ candidates
            return np.concatenate([softplus(f).sum(0), softplus(-f[positive]).sum(0), softplus(f[positive]).sum(0)])

        u_neg, p_pos, p_neg = sums(train, body).reshape(3, -1)
        negative = u_neg / n - prior * p_neg / n_p
        return prior * p_pos / n_p + np.maximum(negative, 0) + 0.5 * (penalty[:, None] * candidates**2).sum(0)

    w = np.zeros(d)
    for _ in range(3):  # positives against unlabelled rows: the sum of the mean losses of both
        m = parts(w, True)
        w = w - step(w, m["g_u"] + m["g_pos"], m["h_u"] + m["h_p"])

    def histogram(x, positive):
        x, positive = x[~half(x)], positive[~half(x)]
        at = np.minimum((sigmoid(expand(x, mean, scale) @ w) * BINS).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(at[positive], minlength=BINS), np.bincount(at, minlength=BINS)]).astype(float)

    h = sums(train, histogram)
    prior = estimate_prior(h[:BINS], h[BINS:]) if h[:BINS].any() else 0.5
    w = np.r_[np.zeros(d - 1), np.log(prior / (1 - prior))]
    lengths, best = np.array([1.0, 0.75, 0.5, 0.25, 0.1]), np.inf
    for _ in range(steps):
        moves = directions(w, prior)
        candidates = w[:, None] - np.concatenate([np.zeros((d, 1)), *(moves[:, [j]] * lengths for j in range(moves.shape[1]))], axis=1)
        r = risks(candidates, prior)
        at = int(np.argmin(r))
        w = candidates[:, at]
        if at == 0 or best - r[at] < 1e-5:
            break
        best = r[at]
    return Model(mean, scale, w, prior)


def fit_positives(x: DataFrame, positives: DataFrame, spark: SparkSession) -> Model | None:
    """Fit on the rows (doc_id, x) with may_train; those of positives are trusted."""
    keys = positives.select(F.col("doc_id").alias("key")).dropna().distinct()
    marked = x.where("may_train").join(keys, F.col("doc_id") == F.col("key"), "left").select("x", F.col("key").isNotNull().alias("positive"))
    return fit(materialise(marked, spark))


def score_of(x: Column, model: Model) -> Column:
    """The model's score of a feature array, in native expressions."""
    size = FEATURES
    number = lambda v: F.array(*[F.lit(float(i)) for i in v])
    w = model.weights
    each = F.arrays_zip(x.alias("x"), *[number(v).alias(n) for n, v in zip("mswhl", (model.mean, model.scale, w[:size], w[size : 2 * size], w[2 * size : 3 * size]))])

    def term(total: Column, row: Column) -> Column:
        z = F.greatest(F.least((row["x"] - row["m"]) / row["s"], F.lit(8.0)), F.lit(-8.0))
        zero = F.lit(0.0)
        return total + z * row["w"] + F.greatest(z - 1, zero) * row["h"] + F.greatest(-z - 1, zero) * row["l"]

    f = F.aggregate(each, F.lit(float(w[-1])), term)
    return 1 / (1 + F.exp(-F.greatest(F.least(f, F.lit(60.0)), F.lit(-60.0))))


def scored(df: DataFrame, positives: DataFrame, train: Column, spark: SparkSession, keep: list[str]) -> DataFrame:
    """One row for each of df: others (a struct of the columns of keep), doc_id and score. Texts become features once."""
    others = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    rows = df.select(others.alias("others"), "doc_id", "text", F.coalesce(train, F.lit(False)).alias("may_train"))
    x = materialise(with_features(rows), spark)
    model = fit_positives(x, positives, spark)
    score = F.lit(0.5) if model is None else score_of(F.col("x"), model)
    return x.select("others", "doc_id", score.alias("score"))


def score_texts(df: DataFrame, positives: DataFrame, train: Column, spark: SparkSession, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, text) become rows (doc_id, score, predicted): score is the probability of good quality.

    positives: the doc_ids of trusted texts; train: which rows may be learned from. Without trusted training
    texts every score is 0.5. Null and empty texts are scored by their features, which are all 0. Rows without
    doc_id are never positives. Equal texts have equal scores; an empty table gives an empty one. A text is held in one
    task as a whole, with a few numbers for each of its words.
    """
    out = scored(df, positives, train, spark, [])
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, positives: DataFrame, train: Column, spark: SparkSession, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose texts score at least `threshold`, fitted as in score_texts."""
    good = scored(docs, positives, train, spark, docs.columns).where(F.col("score") >= threshold)
    return good.select(*[F.col("others").getField(c).alias(c) for c in docs.columns])
