"""Readers of labelled tables and decisions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.labels import with_source_index
from assay.sources.images import image_manifest

#: Texts that stand for a missing value in a CSV file. Fixed values.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header: missing tokens become null, then columns whose values all are numbers or truth
    values are cast. Adds source_index, the position in the file. A table without rows is an error."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    clean = raw.select(*[F.when(F.col(f"`{c}`").isin(NA_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    tests = {"long": r"^\s*[+-]?\d{1,18}\s*$", "double": None, "boolean": r"^(?i:true|false)$"}
    parts = [F.count("*").alias("n")]
    for i, c in enumerate(raw.columns):
        col = F.col(f"`{c}`")
        ok = {k: col.rlike(r) if r else col.try_cast("double").isNotNull() for k, r in tests.items()}
        parts += [F.count(col).alias(f"some{i}"), *[F.coalesce(F.min(F.when(col.isNotNull(), v)), F.lit(False)).alias(f"{k}{i}") for k, v in ok.items()]]
    facts = clean.agg(*parts).first()
    if not facts["n"]:
        raise ValueError("the table has no rows")
    kinds = [next((k for k in ("long", "double", "boolean") if facts[f"{k}{i}"]), "double" if not facts[f"some{i}"] else "string") for i in range(len(raw.columns))]
    typed = clean.select(*[F.trim(F.col(f"`{c}`")).cast(k).alias(c) if k != "string" else F.col(f"`{c}`") for c, k in zip(raw.columns, kinds)])
    return with_source_index(typed)


DECISIONS = T.StructType([T.StructField("source_index", T.LongType()), T.StructField("action", T.StringType()), T.StructField("new_label", T.StringType())])


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """(source_index, action, new_label) from a JSON object by index, or from one with a list `rows`."""
    with open(path, encoding="utf-8") as f:
        return decisions_frame(spark, json.load(f))


def decisions_frame(spark: SparkSession, data: dict) -> DataFrame:
    if not isinstance(data, dict):
        raise ValueError("decisions must be an object")
    if isinstance(data.get("rows"), list):
        pairs = [(r.get("source_index"), r) for r in data["rows"]]
    else:
        pairs = list(data.items())
    rows = []
    for index, d in pairs:
        if not isinstance(d, dict):
            raise ValueError(f"the decision on row {index} is no object")
        rows.append((int(index), d.get("action", "keep"), d.get("new_label")))
    return spark.createDataFrame(rows, DECISIONS)


def synthetic_text(spark: SparkSession, n_per_class: int = 40, seed: int = 42) -> DataFrame:
    """(note_id, note, topic): four topics, each note of 10 to 15 words: a fifth filler, some of other topics."""
    topics = {
        "music": "violin chord tempo melody rhythm concert opera drum flute choir harmony tune".split(),
        "mining": "ore shaft quarry gravel drill seam tunnel copper miner rock slag pit".split(),
        "sailing": "mast rudder keel anchor sail deck tide knot buoy hull crew wind".split(),
        "baking": "flour yeast oven dough crust loaf butter pastry cake sugar rise knead".split(),
    }
    filler = "the then with about after some near very while also over under".split()
    names = list(topics)
    words = F.array(*[F.array(*map(F.lit, topics[t])) for t in names])
    h = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(1 << 30))
    df = spark.range(n_per_class * len(names)).withColumn("t", (F.col("id") % len(names)).cast("int"))

    def word(i):
        draw, pick = h("id", i, F.lit("d")) % 100, (h("id", i, F.lit("w")) % 12 + 1).cast("int")
        other = ((F.col("t") + 1 + h("id", i, F.lit("o")) % (len(names) - 1)) % len(names) + 1).cast("int")
        own = F.element_at(F.element_at(words, F.col("t") + 1), pick)
        return F.when(draw < 22, F.element_at(F.array(*map(F.lit, filler)), pick)).when(draw < 40, F.element_at(F.element_at(words, other), pick)).otherwise(own)

    note = F.array_join(F.transform(F.sequence(F.lit(1), (10 + h("id", F.lit("n")) % 6).cast("int")), word), " ")
    topic = F.element_at(F.array(*map(F.lit, names)), F.col("t") + 1)
    return df.select(F.col("id").alias("source_index"), F.format_string("note-%03d", "id").alias("note_id"), note.alias("note"), topic.alias("topic"))


def synthetic_clusters(spark: SparkSession, sizes: dict[str, int], dims: int = 3, gap: float = 3.0, spread: float = 1.0, seed: int = 42) -> DataFrame:
    """(source_index, features, label): a Gaussian cluster for each label, `gap` apart on every axis."""
    from itertools import accumulate

    names, ends = list(sizes), list(accumulate(sizes.values()))
    u = lambda j, s: (F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(j), F.lit(s)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    which = F.lit(0)
    for i, e in enumerate(ends[:-1]):
        which = F.when(F.col("id") >= e, i + 1).otherwise(which)
    normal = lambda j: F.sqrt(-2 * F.log(u(j, "a"))) * F.cos(2 * 3.141592653589793 * u(j, "b"))
    df = spark.range(ends[-1]).withColumn("c", which)
    features = F.array(*[normal(j) * spread + F.col("c") * gap for j in range(dims)])
    return df.select(F.col("id").alias("source_index"), features.alias("features"), F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1).alias("label"))


def ambiguous_minority(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Two classes of 80 rows, and a small one between them."""
    return synthetic_clusters(spark, {"left": 80, "minority": 24, "right": 80}, gap=1.5, seed=seed)


def flowers(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Three classes of 50 rows and four numbers, two of them neighbours that overlap."""
    return synthetic_clusters(spark, {"early": 50, "middle": 50, "late": 50}, dims=4, gap=1.8, spread=0.8, seed=seed)


def assays(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Three classes and 13 numbers of unlike scales, from hundredths to hundreds."""
    df = synthetic_clusters(spark, {"north": 60, "south": 70, "west": 48}, dims=13, gap=0.9, spread=0.8, seed=seed)
    return df.withColumn("features", F.transform("features", lambda x, j: x * F.pow(F.lit(10.0), F.pmod(j, F.lit(5)) - 2)))


def glyphs(spark: SparkSession, n_per_class: int = 36, seed: int = 42) -> DataFrame:
    """Pictures of 8 x 8 pixels of ink from 0 to 16 in ten classes: each class has a shape of its own, each picture some
    pixels too light, too dark or moved by one column."""
    u = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(1 << 20)) / float(1 << 20)
    df = spark.range(10 * n_per_class).withColumn("c", (F.col("id") % 10).cast("int"))
    moved = F.when(u("id", F.lit("m")) < 0.2, 1).otherwise(0)

    def pixel(j):
        ink = F.when(u("c", F.pmod(j + F.col("moved"), F.lit(64)), F.lit("s")) < 0.4, 13.0).otherwise(1.0)
        return F.round(F.least(F.greatest(ink + 7 * (u("id", j, F.lit("n")) - 0.5) * 2, F.lit(0.0)), F.lit(16.0)))

    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), pixel)
    return df.withColumn("moved", moved).select(F.col("id").alias("source_index"), pixels.alias("features"), F.col("c").cast("string").alias("label"))


#: name -> (kind, loader): tables that come with the engine.
BUILTIN = {
    "synthetic_text": ("table", synthetic_text), "ambiguous_minority": ("matrix", ambiguous_minority), "flowers": ("matrix", flowers),
    "assays": ("matrix", assays), "glyphs": ("matrix", glyphs),
}


def load_builtin(spark: SparkSession, name: str, seed: int = 42) -> DataFrame:
    if name not in BUILTIN:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(BUILTIN)}")
    return BUILTIN[name][1](spark, seed=seed)


def image_records(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """The rows of images.image_manifest, in order, as a list: for folders and lists of a few images."""
    return sorted(map(tuple, image_manifest(spark, root).collect()))
