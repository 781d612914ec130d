"""Preprocessors fitted on training rows only, and out-of-fold class probabilities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import log
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.scratch import settled
from assay.operators import selection, softmax
from assay.operators.packed import pack
from assay.operators.terms import SLICE, TERMS, in_slices, joined_words, term_counts, unit_weights, vocabularies, weighed, words_column, words_in

ROWS_A_PARTITION = 1000


class Transform(Protocol):
    def __call__(self, df: DataFrame) -> DataFrame: ...


#: Fits on training rows and returns what adds a vector column `z` to any rows. One with an attribute `folds` can fit all
#: folds at once: folds(df, left_out) returns a transform for each number of left_out, fitted on the rows of the other folds.
#: One with an attribute `cut`, columns by name, gets rows with these, which are then computed once.
Preprocessor = Callable[[DataFrame], Transform]


@dataclass
class Affine:
    """Centre and scale the array column `features`."""

    centre: np.ndarray
    scale: np.ndarray

    def __call__(self, df: DataFrame) -> DataFrame:
        centre, factor = (F.array(*[F.lit(float(v)) for v in values]) for values in (self.centre, self.scale))
        centred = F.zip_with(F.col("features").cast("array<double>"), centre, lambda x, m: x - m)
        return df.withColumn("z", array_to_vector(F.zip_with(centred, factor, lambda x, s: x / s)))


@dataclass
class Weighted:
    """Weigh the counts of a text's terms, and make them of unit length. Folds share `vocabulary`; a term that a fold
    hasn't weighs nothing there."""

    text: str
    vocabulary: list[str]
    weights: np.ndarray

    def counted(self, df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, term_counts(words_in(df, self.text), self.vocabulary))

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.counted(df, "__counts").withColumn("z", weighed(F.col("__counts"), self.weights)).drop("__counts")


def merged(parts: list[tuple]) -> tuple:
    """(number, mean, sum of squares about the mean) of several groups as those of one: no difference of large sums."""
    n, mean, squares = 0, 0.0, 0.0
    for m, other, more in parts:
        if m:
            apart = other - mean
            squares = squares + more + apart * apart * (n * m / (n + m))
            mean = mean + apart * (m / (n + m))
            n += m
    return n, mean, squares


def one_fold(train: DataFrame) -> DataFrame:
    """All rows as fold 1, for statistics that leave out no fold."""
    return train.withColumn("oof_fold", F.lit(1))


def standardize_folds(df: DataFrame, left_out: list[int]) -> list[Affine]:
    """Means and population deviations of every fold's training rows, from one aggregate of each fold."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("features")).alias("s")
    per = [(r["oof_fold"], r["count"], r["mean"].toArray(), r["variance"].toArray()) for r in df.groupBy("oof_fold").agg(summary).select("oof_fold", "s.*").collect()]
    out = []
    for f in left_out:
        n, mean, squares = merged([(n, m, v * (n - 1)) for own, n, m, v in per if own != f])
        variance = squares / max(n, 1) * np.ones(np.shape(mean))
        out.append(Affine(mean, np.sqrt(np.where(variance > 0, variance, 1.0))))
    return out


def standardize_matrix(train: DataFrame) -> Transform:
    """Centre and scale the array column `features` by mean and population deviation; a constant stays unscaled."""
    return standardize_folds(one_fold(train), [0])[0]


standardize_matrix.folds = standardize_folds


def vocabulary(train: DataFrame, column: str, size: int = TERMS) -> DataFrame:
    """(term, n, df): the most frequent terms, ties by term."""
    return vocabularies(one_fold(train), column, [0], size)[0]


def fold_vocabularies(df: DataFrame, column: str, left_out: list[int], size: int = TERMS) -> list[list]:
    """The vocabulary of the training rows of every fold, from counts of all folds (see terms)."""
    return [t.collect() for t in vocabularies(df, column, left_out, size)]  # size rows each


def fold_numeric_statistics(df: DataFrame, columns: list[str], left_out: list[int]) -> list[list[tuple[str, float | None, float | None, float | None]]]:
    """For each fold that is left out (column, median, mean, population deviation) of the other rows. Mean and deviation
    count missing values as the median; a column without values has none of them.

    Moments come from one aggregate of each fold. Medians come from counts by stretches of values of all folds and columns at
    once (see selection): no task holds a column.
    """
    parts = [f(filled(c, None)).alias(f"{f.__name__}{i}") for i, c in enumerate(columns) for f in (F.count, F.avg, F.var_pop)]
    own = df.groupBy("oof_fold").agg(F.count("*").alias("rows"), *parts).collect()
    known = {(f, i): sum(r[f"count{i}"] for r in own if r["oof_fold"] != f) for f in left_out for i in range(len(columns))}
    needs = [(f, i, side, (n + 1 + side) // 2) for (f, i), n in known.items() if n for side in (0, 1)]
    medians: dict[tuple[int, int], float] = {}
    if needs:
        spark = df.sparkSession
        values = F.array(*[F.struct(F.lit(i).alias("i"), filled(c, None).alias("x")) for i, c in enumerate(columns)])
        others = F.filter(F.array(*map(F.lit, left_out)), lambda f: f != F.col("oof_fold"))
        rows = df.select(others.alias("others"), F.inline(values)).where("x is not null").select("i", "x", F.explode("others").alias("f"))
        rows = rows.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        middle = selection.kth_largest(rows, spark.createDataFrame(needs, "f int, i int, side int, need long"), ["f", "i", "side"], "x")
        for r in middle.collect():
            medians[r["f"], r["i"]] = medians.get((r["f"], r["i"]), 0.0) + 0.5 * r["kth"]
    out = []
    for f in left_out:
        stats = []
        for i, c in enumerate(columns):
            median = medians.get((f, i))
            if median is None:
                stats.append((c, None, None, None))
                continue
            rest = [r for r in own if r["oof_fold"] != f]
            groups = [(r[f"count{i}"], r[f"avg{i}"], r[f"var_pop{i}"] * r[f"count{i}"]) for r in rest if r[f"count{i}"]]
            n, mean, squares = merged([*groups, (sum(r["rows"] for r in rest) - known[f, i], median, 0.0)])
            stats.append((c, median, mean, (squares / n) ** 0.5))
        out.append(stats)
    return out


def numeric_statistics(train: DataFrame, columns: list[str]) -> list[tuple[str, float | None, float | None, float | None]]:
    return fold_numeric_statistics(one_fold(train), columns, [0])[0]


def filled(column: str, median: float | None) -> Column:
    value = F.col(f"`{column}`").cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(median).cast("double"))


def fold_levels(df: DataFrame, columns: list[str], left_out: list[int]) -> list[list[list[str]]]:
    """For each fold that is left out and each column the levels of the other rows, in order."""
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("level")) for i, c in enumerate(columns)])
    found = df.select("oof_fold", F.inline(values)).where("level is not null").groupBy("i", "level").agg(F.collect_set("oof_fold").alias("folds")).collect()
    return [[sorted(r["level"] for r in found if r["i"] == i and set(r["folds"]) - {f}) for i in range(len(columns))] for f in left_out]


def table_preprocessor(kinds: dict[str, list[str]]) -> Preprocessor:
    """Numbers: median for missing ones, then standardised. Categories: one slot a training level, none for others.
    Texts: tf-idf of words and pairs, of unit length."""
    numeric, categorical, texts = kinds["numeric"], kinds["categorical"], kinds["text"]

    def folds(df: DataFrame, left_out: list[int]) -> list[Transform]:
        statistics = fold_numeric_statistics(df, numeric, left_out) if numeric else [[] for _ in left_out]
        levels = fold_levels(df, categorical, left_out) if categorical else [[] for _ in left_out]
        sizes = {r["oof_fold"]: r["count"] for r in df.groupBy("oof_fold").count().collect()} if texts else {}
        terms = [fold_vocabularies(df, c, left_out) for c in texts]
        if len(left_out) > 1 and len(texts) == 1 and not numeric and not categorical and all(terms[0]):
            shared = sorted({r["term"] for found in terms[0] for r in found})
            place, out = {t: i for i, t in enumerate(shared)}, []
            for f, found in zip(left_out, terms[0]):
                weights, n = np.zeros(len(shared)), sum(rows for g, rows in sizes.items() if g != f)
                weights[[place[r["term"]] for r in found]] = [log((1 + n) / (1 + r["df"])) + 1 for r in found]
                out.append(Weighted(texts[0], shared, weights))
            return out
        sample = df.limit(1)
        return [one(sample, statistics[j], levels[j], [t[j] for t in terms], sum(n for g, n in sizes.items() if g != f)) for j, f in enumerate(left_out)]

    def one(sample: DataFrame, statistics: list[tuple], levels: list[list[str]], vocabularies: list[list], n: int) -> Transform:
        stages: list[Transform] = []
        parts: list[str] = []
        known = [x for x in statistics if x[1] is not None]  # a column without values goes
        if known:
            scaled = [(filled(c, median) - mean) / (deviation or 1.0) for c, median, mean, deviation in known]
            stages.append(lambda df: df.withColumn("__num", array_to_vector(F.array(*scaled))))
            parts.append("__num")
        sure = [(i, c, own) for i, (c, own) in enumerate(zip(categorical, levels)) if own]
        if sure:
            index, hot = [f"__i{i}" for i, _, _ in sure], [f"__h{i}" for i, _, _ in sure]
            indexer = StringIndexerModel.from_arrays_of_labels([own for _, _, own in sure], inputCols=[c for _, c, _ in sure], outputCols=index, handleInvalid="keep")
            encoder = OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True).fit(indexer.transform(sample))  # reads the names of the levels, no rows
            stages.append(lambda df: encoder.transform(indexer.transform(df)).drop(*index))
            parts += hot
        for i, (c, found) in enumerate(zip(texts, vocabularies)):
            if not found:
                continue
            vector = unit_weights(F.col(f"__words{i}"), [r["term"] for r in found], [log((1 + n) / (1 + r["df"])) + 1 for r in found])
            stages.append(lambda df, name=f"__t{i}", vector=vector: df.withColumn(name, vector))
            parts.append(f"__t{i}")
        if not parts:
            raise ValueError("no feature has values in the training rows")
        joined = VectorAssembler(inputCols=parts, outputCol="z")

        cut = {f"__words{i}": joined_words(F.col(f"`{c}`")) for i, c in enumerate(texts)}

        def transform(df: DataFrame) -> DataFrame:
            given = set(df.columns)
            rows = df.withColumns({name: words for name, words in cut.items() if name not in given})
            return joined.transform(reduce(lambda d, f: f(d), stages, rows)).drop(*parts, *(set(cut) - given))

        transform.cut = cut
        return transform

    def fit(train: DataFrame) -> Transform:
        return folds(one_fold(train), [0])[0]

    fit.folds = folds
    if len(texts) == 1 and not numeric and not categorical:
        fit.cut = {words_column(texts[0]): joined_words(F.col(f"`{texts[0]}`"))}
    return fit


@dataclass
class Fold:
    """shape: the number of rows, and the length of a vector. Of folds that weigh counts, the packed rows of all of them
    (see packed), and the fold's weights."""

    fold: int
    rows: DataFrame
    shape: tuple[int, int]
    packed: DataFrame | None = None
    weights: np.ndarray | None = None


def out_of_fold(
    df: DataFrame,
    n_classes: int,
    k: int,
    preprocessor: Preprocessor,
    columns: list[str],
    max_iter: int = 400,
    tol: float = 1e-6,
    progress: Callable[[str], None] = lambda _: None,
) -> tuple[DataFrame, list[Fold]]:
    """Class probabilities of rows with y and oof_fold, each from a model that hasn't seen the row's fold.

    Returns `columns` with proba, and each fold's transformed rows (all rows, in the space fitted on its training rows)
    for the neighbour search. Preprocessors are fitted on the training rows of each fold: for all folds at once if they
    can (see Preprocessor), else one by one. Rows are written once, with a vector for each fold, or as they are where
    folds only centre and scale them or weigh counts; then all models are fitted together, a job a step.
    """
    numbers = list(range(1, k + 1))
    if hasattr(preprocessor, "cut"):
        df = settled(df.select(*columns, "y", "oof_fold", *[c.alias(name) for name, c in preprocessor.cut.items()]))
    if hasattr(preprocessor, "folds"):
        progress(f"preprocessing of {k} folds")
        transforms = preprocessor.folds(df, numbers)
    else:
        transforms = []
        for f in numbers:
            progress(f"fold {f} of {k}")
            transforms.append(preprocessor(df.where(F.col("oof_fold") != f)))
    keep = [*columns, "y", "oof_fold"]
    # every step of the solver is a job: a small table in many partitions pays for their scheduling
    n = df.count()
    tasks = max(1, n // ROWS_A_PARTITION)
    packed = None
    if all(isinstance(t, Affine) for t in transforms):
        rows = settled(df.select(*keep, array_to_vector(F.col("features").cast("array<double>")).alias("z1")).coalesce(tasks))
        spaces = [softmax.Space("z1", t.centre, t.scale) for t in transforms]
        widths = [len(t.centre) for t in transforms]
        seen = [t(rows.withColumn("features", vector_to_array("z1"))).select(*keep, "z") for t in transforms]
    elif all(isinstance(t, Weighted) for t in transforms):
        rows = settled(transforms[0].counted(df, "z1").select(*keep, "z1").coalesce(tasks))
        spaces = [softmax.Space("z1", weights=t.weights) for t in transforms]
        widths = [len(t.weights) for t in transforms]
        seen = [rows.select(*keep, weighed(F.col("z1"), t.weights).alias("z")) for t in transforms]
        packed = settled(pack(rows, "z1", [t.weights for t in transforms]))
    else:
        wide = df.withColumns(getattr(transforms[0], "cut", {}))
        for f, t in zip(numbers, transforms):
            wide = t(wide).withColumnRenamed("z", f"z{f}")
        names = [f"z{f}" for f in numbers]
        rows = settled(wide.select(*keep, *names).coalesce(tasks))
        spaces = [softmax.Space(z) for z in names]
        sizes = vector_sizes(rows, names)
        widths = [sizes[z] for z in names]
        seen = [rows.select(*keep, F.col(z).alias("z")) for z in names]
    progress("models of all folds")
    fitted = packed.select("chunk") if packed else rows.select("y", "oof_fold", *dict.fromkeys(s.column for s in spaces))
    if packed:
        tasks = max(fitted.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
        fitted = fitted.repartition(tasks)  # packed rows are small, and may lie in few files
    fitted = fitted.persist()
    weights = softmax.fit(fitted, spaces, widths, n_classes, max_iter, tol, tasks)
    fitted.unpersist()
    return softmax.predict(rows, spaces, weights, columns), [Fold(f, z, (n, w), packed, s.weights) for f, z, w, s in zip(numbers, seen, widths, spaces)]


def vector_sizes(rows: DataFrame, names: list[str]) -> dict[str, int]:
    """The length of each vector column, as its first row has it."""
    first = rows.select(*names).first()
    return {z: first[z].size if first else 0 for z in names}


def positive(column: str) -> Column:
    """(n_terms, total, largest) of the values above 0 of a vector column, from what it stores: sparse ones stay so."""
    kinds = {"n_terms": ("long", pa.int64()), "total": ("double", pa.float64()), "largest": ("double", pa.float64())}

    def one(vectors: pa.Array) -> pa.Array:
        stored = vectors.field("values")
        x, rows = stored.flatten().to_numpy(), np.repeat(np.arange(len(stored)), np.diff(stored.offsets.to_numpy()))
        rows, x = rows[x > 0], x[x > 0]
        largest = np.zeros(len(stored))
        np.maximum.at(largest, rows, x)
        found = np.bincount(rows, minlength=len(stored)), np.bincount(rows, x, minlength=len(stored)), largest
        return pa.StructArray.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(found, kinds.values())], names=list(kinds))

    step = SLICE

    @F.arrow_udf(", ".join(f"{name} {kind}" for name, (kind, _) in kinds.items()))
    def facts(vectors: pa.Array) -> pa.Array:
        return in_slices(one, vectors, step)

    return facts(F.col(column))
