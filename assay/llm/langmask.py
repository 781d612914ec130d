"""Language identification by bit-sliced Bloom filters of letter trigrams.

A slot of the filter holds one bit for each language. The AND of an n-gram's slots names all languages that
contain it; a text's languages are counted over its n-grams, and the counts are corrected for the false
positives that the fill of each language's slice makes certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import map_column, materialise, slices

#: Languages at most: eight masks a slot.
MOST_LANGUAGES = 512
PROBES = 3
#: Characters whose trigrams are taken at a time.
PIECE = 1 << 19
_FOLD: list[np.ndarray] = []


def fold() -> np.ndarray:
    """Code point to lower-case letter, or to a space for all that is no letter."""
    if not _FOLD:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x33480):  # beyond are no letters
            if (ch := chr(c)).isalpha():
                table[c] = ord(ch.lower()[0])
        _FOLD.append(table)
    return _FOLD[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram codes of all texts in one array, and how many each text has; words are padded with a space."""
    raw = "".join(f"\n{t}\n" if t else "\n\n" for t in texts).encode("utf-32-le", "replace")
    points = fold()[np.frombuffer(raw, np.uint32)]
    owner = np.repeat(np.arange(len(texts)), [len(t or "") + 2 for t in texts])
    keep = ~((points == 32) & np.r_[False, (points[:-1] == 32) & (owner[1:] == owner[:-1])])
    points, owner = points[keep].astype(np.uint64), owner[keep]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    code = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
    good = (points[1:-1] != 32) & (owner[:-2] == owner[2:])
    return code[good].view(np.int64), np.bincount(owner[:-2][good], minlength=len(texts))


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in batches of about PIECE characters: which text each piece is of, and the pieces.

    A longer text is cut behind its last character of a piece that is no letter, which changes no trigram; only a word
    of more than PIECE letters is counted in parts.
    """
    owners, held, size = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while text and start < len(text):
            end = min(len(text), start + PIECE)
            if end < len(text):
                end = next((j for j in range(end, start, -1) if not text[j - 1].isalpha()), end)
            if held and size + end - start > PIECE:
                yield owners, held
                owners, held, size = [], [], 0
            owners.append(i)
            held.append(text[start:end])
            size, start = size + end - start, end
    if held:
        yield owners, held


def slots_of(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    x = codes.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return [((x + np.uint64(j) * step) & np.uint64(slots - 1)).astype(np.int64) for j in range(PROBES)]


def gram_counts(df: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (text, lang), summed within tasks first."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for lang, (grams, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=schema.names)
            held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                langs = np.array(part.column(1).to_pylist(), object)
                texts = part.column(0).to_pylist()
                for lang in set(langs):
                    for _, some in pieces([t for t, x in zip(texts, langs) if x == lang]):
                        grams, n = np.unique(trigrams(some)[0], return_counts=True)
                        if lang in held:
                            both = np.concatenate([held[lang][0], grams])
                            grams, at = np.unique(both, return_inverse=True)
                            n = np.bincount(at, np.concatenate([held[lang][1], n]), len(grams)).astype(np.int64)
                        held[lang] = grams, n.astype(np.int64)
                if sum(len(g) for g, _ in held.values()) > 1_000_000:
                    yield from flush()
        yield from flush()

    return df.select("text", "lang").mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """The fitted filter: languages by bit, planes of 64 languages, and the fill of each language's slice."""

    def __init__(self, langs: list[str], planes: np.ndarray, common: int):
        self.langs, self.planes, self.common = langs, planes, common
        self.slots = planes.shape[1] if len(planes) else 1
        fill = np.array([((planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
        self.false = fill**PROBES

    def hits_of(self, codes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For stretches of trigrams, each from one start to the next: how many each language has."""
        out = np.zeros((len(start), len(self.langs)))
        at = slots_of(codes, self.slots)
        for p in range(len(self.planes)):
            mask = self.planes[p][at[0]]
            for a in at[1:]:
                mask &= self.planes[p][a]
            for i in range(64 * p, min(64 * (p + 1), len(self.langs))):
                out[:, i] = np.add.reduceat(((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64), start)
        return out

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        hits, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for owners, held in pieces(texts):
            codes, n = trigrams(held)
            np.add.at(counts, owners, n)
            some = np.flatnonzero(n)
            if len(some) and self.langs:
                np.add.at(hits, np.array(owners)[some], self.hits_of(codes, (np.cumsum(n) - n)[some]))
        fixed = np.maximum(hits - counts[:, None] * self.false, 0) / np.maximum(1 - self.false, 1e-9)
        total = fixed.sum(axis=1)
        best = np.where(total > 0, fixed.argmax(axis=1) if self.langs else 0, self.common)
        score = np.where(total > 0, fixed.max(axis=1, initial=0) / np.maximum(total, 1e-300), 0.0)
        names = [self.langs[b] if n and self.langs else "und" for b, n in zip(best, counts)]
        return names, np.where([x != "und" for x in names], score, 0.0).clip(0, 1).tolist()


def fit(train: DataFrame, spark: SparkSession, ratio: float = 0.5, min_share: float = 2e-6, most_slots: int = 1 << 22) -> Filter:
    """Learn the filter from all rows (text, lang) with a lang.

    A language contains a trigram if its share among the language's trigrams is at least min_share (so that at
    most 1 / min_share trigrams of a language enter) and `ratio` times the largest share in any language.
    What comes to the driver, and is broadcast, is one row a language and one mask a slot and 64 languages: MOST_LANGUAGES
    (more are an error) and most_slots at most.
    """
    counts = materialise(gram_counts(train.where("lang is not null and text is not null")), spark)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = [(r["lang"], r["total"]) for r in totals.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not langs:
        return Filter([], np.zeros((0, 1), np.uint64), 0)
    ids = spark.createDataFrame([(x, i, t) for i, (x, t) in enumerate(langs)], "lang string, id int, total long")
    shares = counts.join(F.broadcast(ids), "lang").withColumn("share", F.col("n") / F.col("total"))
    best = F.max("share").over(Window.partitionBy("gram"))  # a row a language at most
    chosen = shares.withColumn("best", best).where((F.col("share") >= min_share) & (F.col("share") >= ratio * F.col("best")))
    masks = chosen.groupBy("gram", F.floor(F.col("id") / 64).cast("int").alias("plane")).agg(
        F.bit_or(F.expr("shiftleft(1L, id % 64)")).alias("mask")
    )
    masks = materialise(masks, spark)
    slots = 1 << max(12, min(most_slots, 16 * masks.count()).bit_length() - 1)
    schema = T.StructType([T.StructField("slot", T.LongType()), T.StructField("plane", T.IntegerType()), T.StructField("mask", T.LongType())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for slot in slots_of(b.column(0).to_numpy(), slots):
                yield pa.RecordBatch.from_arrays([pa.array(slot), b.column(1), b.column(2)], names=schema.names)

    filled = masks.select("gram", "plane", "mask").mapInArrow(spread, schema).groupBy("slot", "plane").agg(F.bit_or("mask").alias("mask")).toArrow()
    planes = np.zeros(((len(langs) + 63) // 64, slots), np.uint64)
    planes[filled["plane"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    return Filter([x for x, _ in langs], planes, int(np.argmax([t for _, t in langs])))


def identify(df: DataFrame, fitted: Filter, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add lang_pred and score (the winner's share of all corrected counts) for each whole text.

    `und` with score 0 stands for a null text and one without letters, or if nothing was learned. A text whose
    trigrams no language has gets the most common language, with score 0. Ties go to the first language. Equal texts get
    equal results. Columns named like a new one are replaced, others stay; an empty table gives an empty one. Long texts
    are counted a stretch at a time.
    """
    shared = df.sparkSession.sparkContext.broadcast(fitted)

    def make():
        def kernel(texts):
            names, scores = shared.value.classify(texts.to_pylist())
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return kernel

    return map_column(df, text, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], drop)
