"""Row positions, labels and classes."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.scratch import settled

#: What a missing label is called: it is a class of its own.
MISSING = "nan"
PREFIX = "__assay_"
INDEX = f"{PREFIX}source_index"
#: Classes are held in lists of the driver, and the confident joint has a cell for each pair of them.
MOST_CLASSES = 1000


def with_source_index(df: DataFrame, name: str = "source_index") -> DataFrame:
    """Number the rows 0, 1, ... in their present order (that of the files for a table just read)."""
    return _numbered(df, name)


def in_order(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """Number the rows first, first + 1, ... in an order that ties nothing, or ties equal rows only.

    Rows are sorted by range, so that no task holds them all.
    """
    return _numbered(df.orderBy(*order), name, first)


def _numbered(df: DataFrame, name: str, first: int = 0) -> DataFrame:
    """Rows are marked by partition and place and written in one job; each partition starts where the one before ends.

    Without the written table the job that counts and the one that numbers could cut a sorted table differently.
    """
    marked = settled(df.withColumn(f"{PREFIX}id", F.monotonically_increasing_id()))
    part, place = F.shiftright(f"{PREFIX}id", 33), F.col(f"{PREFIX}id").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["n"]) for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
    starts = accumulate([first, *(n for _, n in counts)])
    offsets = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], f"{PREFIX}part long, {PREFIX}start long")
    both = marked.withColumn(f"{PREFIX}part", part).join(F.broadcast(offsets), f"{PREFIX}part")
    return both.withColumn(name, place + F.col(f"{PREFIX}start")).drop(f"{PREFIX}id", f"{PREFIX}part", f"{PREFIX}start")


def python_number(value: Column) -> Column:
    """A double as the text of the shortest decimal that reads back, in exponents from 1e16 and below 1e-4 only."""
    text = F.abs(value).cast("string")
    exponent = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    mantissa = F.regexp_replace(text, r"E.*$", "")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    whole = F.rpad(digits, F.greatest(F.length(digits), exponent + 1), F.lit("0"))
    after = F.substr(whole, exponent + 2)
    plain = F.concat(F.substr(whole, F.lit(1), exponent + 1), F.lit("."), F.when(after == "", F.lit("0")).otherwise(after))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    power = F.concat(F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    power = F.when(F.length(F.abs(exponent).cast("string")) > 2, F.concat(F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.abs(exponent).cast("string"))).otherwise(power)
    out = F.when(~text.contains("E"), text).when((exponent >= 0) & (exponent < 16), plain).when(exponent == -4, small)
    out = out.otherwise(F.concat(F.regexp_replace(mantissa, r"\.0$", ""), power))
    sign = F.when((value < 0) | value.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(value), F.lit("nan")).when(text == "Infinity", F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, out))


def label_text(label: Column, kind: str = "string") -> Column:
    """A label of a column of that kind as text: truth values are True and False, a missing label is a class of its own."""
    text = label.cast("string")
    if kind == "boolean":
        text = F.initcap(text)
    elif kind in ("double", "float"):
        text = python_number(label)
    return F.coalesce(text, F.lit(MISSING))


def text_of(df: DataFrame, label: str) -> Column:
    return label_text(F.col(f"`{label}`"), dict(df.dtypes)[label])


def class_dimension(df: DataFrame, label: str) -> DataFrame:
    """(class_index, class_name): distinct labels as text, in order of code points."""
    names = df.select(text_of(df, label).alias("class_name")).distinct()
    return names.select((F.row_number().over(Window.orderBy("class_name")) - 1).alias("class_index"), "class_name")


def class_names(df: DataFrame, label: str) -> list[str]:
    """The class names in order; fewer than two are an error, and so are more than MOST_CLASSES: that is no label."""
    found = df.select(text_of(df, label).alias("class_name")).distinct().limit(MOST_CLASSES + 1)
    names = sorted(r["class_name"] for r in found.collect())
    if len(names) < 2:
        raise ValueError("at least two classes are needed")
    if len(names) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    return names


def encode(df: DataFrame, label: str, names: list[str]) -> DataFrame:
    """Add given_label (text) and y, its place among the class names (a short list: the classes of one label)."""
    places = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])
    out = df.withColumn("given_label", text_of(df, label))
    return out.withColumn("y", F.element_at(places, F.col("given_label")))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(class_name, n, minority): minority marks every class as small as the smallest."""
    counts = df.groupBy(text_of(df, label).alias("class_name")).agg(F.count("*").alias("n"))
    return counts.withColumn("minority", F.col("n") == F.min("n").over(Window.partitionBy()))


def class_sample(df: DataFrame, label: str, n: int = 12) -> DataFrame:
    return df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("class_name")).distinct().orderBy("class_name").limit(n)
