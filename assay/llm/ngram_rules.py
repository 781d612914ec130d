"""Quality rules: document statistics and a hashed n-gram log-likelihood ratio, in native expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import WORD, fresh

#: Runs of letters and digits, and runs of other visible characters: the n-grams are made of these.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def hashes(strings: Column) -> Column:
    return F.transform(strings, lambda s: F.xxhash64(s))


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur at least twice (64-bit hashes stand for the windows)."""

    def covered(win: Column) -> Column:
        placed = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))

        starts = F.sort_array(F.transform(let(placed, twice), lambda x: x["i"]))
        step = lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(let(starts, step), F.lit(0).cast("long"), lambda a, x: a + x)

    def of_hashes(h: Column) -> Column:
        first = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        win = F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        none = F.lit(0).cast("long")
        return let(win, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(covered(w)))

    return let(hashes(words), of_hashes)


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null or empty text has zeros and fails (fewer than 10 words). A text counts as a whole and is held in one task
    with its words; equal texts have equal values. Other columns stay, but for those named like a new one; an empty table
    gives an empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    words = fresh(df, "words")
    out = df.withColumn(words, words_of(F.col(text))).withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.col(words)),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(words)


def ngram_buckets(text: Column, buckets: int) -> Column:
    """Hash buckets of all 1-grams (lower half) and 2-grams (upper half) of the tokens of a text."""
    half = buckets // 2
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def both(h: Column) -> Column:
        ones = F.transform(h, lambda x: F.pmod(x, F.lit(half)).cast("int"))
        head = F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0)))
        twos = F.transform(head, lambda x, i: (F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(half)) + half).cast("int"))
        return F.concat(ones, twos)

    return let(hashes(tokens), both)


def fit_log_ratios(df: DataFrame, trusted: DataFrame, buckets: int = 1 << 15, text: str = "text", key: str = "doc_id", broadcast_rows: int = 2_000_000) -> list[float]:
    """log(p_target / p_raw) of every bucket, from all texts of df; the target are those whose key is in trusted.

    Counts are summed before they are shuffled, and what comes to the driver has one row a bucket. The target
    is smoothed towards the raw corpus with `buckets` pseudo-counts: without trusted texts all ratios are 0.
    The keys of trusted are broadcast up to broadcast_rows of them, and joined by a shuffle beyond.
    """
    keys = trusted.select(F.col(key).alias("__key")).dropna().distinct()
    if keys.limit(broadcast_rows + 1).count() <= broadcast_rows:
        keys = F.broadcast(keys)
    marked = df.select(key, text).join(keys.withColumn("__in", F.lit(1)), F.col(key) == F.col("__key"), "left")
    grams = marked.select(F.coalesce("__in", F.lit(0)).alias("t"), F.explode(ngram_buckets(F.col(text), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("r"), F.sum("t").alias("t")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for row in counts:
        raw[row["b"]], target[row["b"]] = row["r"], row["t"]
    all_raw, all_target = sum(raw) + buckets, sum(target)
    share = [(r + 1) / all_raw for r in raw]
    return [math.log((t + buckets * p) / (all_target + buckets)) - math.log(p) for t, p in zip(target, share)]


def log_ratio(text: Column, ratios: list[float]) -> Column:
    """Mean log ratio of the n-grams of a text; 0 for a text without any."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return let(ngram_buckets(text, len(ratios)), lambda g: F.when(F.size(g) > 0, total(g) / F.size(g)).otherwise(F.lit(0.0)))


def apply_rules(df: DataFrame, trusted: DataFrame, threshold: float = -0.15, buckets: int = 1 << 15, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add the base statistics, log_ratio (length-normalised) and kept.

    kept is false if the base rules fail, or else whether log_ratio >= threshold: the threshold is a constant,
    so the verdict on a document depends on nothing but its text and the two multinomials.
    Null keys are never trusted; repeated rows get equal results. A ratio that equals the threshold is kept; a text
    without n-grams has the ratio 0. Other columns stay, but for those named like a new one; an empty table gives an empty
    one.
    """
    ratios = fit_log_ratios(df, trusted, buckets, text, key)
    out = base_statistics(df, text).withColumn("log_ratio", log_ratio(F.col(text), ratios))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))


def keep_ruled(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...), with all their columns whatever their names, that apply_rules keeps."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("others")
    ruled = apply_rules(docs.select(others, "doc_id", "text"), trusted).where("kept")
    return ruled.select(*[F.col("others").getField(c).alias(c) for c in docs.columns])


def trusted_keys(labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Keys that are labelled as of good quality, and never otherwise."""
    return labels.groupBy(key).agg(F.min(quality).alias("q")).where("q = 1").select(key)
