"""Helpers shared by the text operators: scratch tables, Arrow kernels and native hashing."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.scratch import new_table

#: A word in the sense of the contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Kernels receive at most about this many bytes of text at a time.
SLICE_BYTES = 4 << 20


def materialise(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there."""
    return Scratch(spark).table(df)


class Scratch:
    """The tables that an operator writes between its steps; those that later steps have superseded can be removed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame) -> DataFrame:
        path = new_table(self.spark, "assay")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing still to be computed reads, in whatever file system they are."""
        context = self.spark.sparkContext
        for path in [p for df, p in self.paths if any(df is t for t in tables)]:
            file = context._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(context._jsc.hadoopConfiguration()).delete(file, True)
        self.paths = [(df, p) for df, p in self.paths if not any(df is t for t in tables)]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{stem}{i or ''}" for i in itertools.count()) if n.lower() not in taken)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no cut holds much more than `limit` bytes of `column` (one long value is a cut)."""
    if batch.num_rows == 0:
        return
    values = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def map_column(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[..., list[pa.Array]]],
    fields: list[T.StructField],
    drop: tuple[str, ...] = (),
    also: tuple[str, ...] = (),
) -> DataFrame:
    """Add `fields`, computed slice by slice from `column` (and those of `also`) by the kernel that `make` builds once
    per task.

    Other columns pass through, but for those of `drop` and those whose names the new fields take.
    """
    taken = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    keep = [f for f in df.schema.fields if f.name.lower() not in taken]
    needed = [*keep, *(df.schema[c] for c in (column, *also) if not any(f.name == c for f in keep))]
    schema = T.StructType([*keep, *fields])
    names, new = [f.name for f in keep], [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in slices(batch, column):
                old = [part.column(part.schema.get_field_index(n)) for n in names]
                made = kernel(*(part.column(part.schema.get_field_index(c)) for c in (column, *also)))
                yield pa.RecordBatch.from_arrays([*old, *made], names=[*names, *new])

    return df.select(*[F.col(f"`{f.name}`") for f in needed]).mapInArrow(run, schema)


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
