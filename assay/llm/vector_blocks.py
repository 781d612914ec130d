"""Exact search over vectors: rows in blocks of bounded size, and every query at every block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import Scratch

#: Rows of a block at most, on average, and the fewest for which a table is cut in more blocks to keep all cores busy.
BLOCK_ROWS, LEAST_ROWS = 16384, 512


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scratch: Scratch, **more: Column) -> DataFrame:
    """(uid, vec_id, x, ...): x has floor(256 * component); uid is a number of the row's own.

    Rows without an id, without a vector, or with a null or non-finite component take no part.
    """
    good = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(F.col(vector), lambda c: F.floor(256 * c.cast("double")))
    usable = df.where(F.col(vec_id).isNotNull() & F.coalesce(good, F.lit(False)))
    return scratch.table(usable.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), *[c.alias(n) for n, c in more.items()]))


def measures(rows: DataFrame) -> tuple[int, int, int]:
    """(rows, components of the longest vector, largest component); an error if a score might not fit in a long."""
    widest = F.max(F.aggregate("x", F.lit(0).cast("long"), lambda m, c: F.greatest(m, F.abs(c)))).alias("most")
    n, width, most = rows.agg(F.count("*"), F.max(F.size("x")), widest).first()
    if n and width * most * most >= 1 << 62:
        raise ValueError("components are too large: scores would not fit in 64 bits")
    return n, width or 0, most or 0


def at_every_block(rows: DataFrame, queries: DataFrame, width: int, n: int, build: Callable, search: Callable, schema: T.StructType, step: int = 16) -> DataFrame:
    """What `search` yields for each block of rows and each query.

    rows and queries have uid, vec_id and x, and may have more columns. A block's rows come to a task first, and
    build(x, columns) makes its index; then queries stream past it, `step` at a time: search(index, x, columns) returns
    the columns of schema. A row travels once, a query once for each block; a task holds one block, however many there are.
    """
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n // BLOCK_ROWS), min(2 * parallel, -(-n // LEAST_ROWS)), 1)
    dealt = rows.withColumns({"block": F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"), "asks": F.lit(0)})
    sent = queries.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "asks": F.lit(1)})
    both = dealt.unionByName(sent, allowMissingColumns=True).repartition(2 * blocks, "block").sortWithinPartitions("block", "asks")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        """Slices of one block, of rows or of queries."""
        for batch in batches:
            block, asks = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("block", "asks"))
            cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])]) if len(block) else []
            for start, end in zip(cuts, [*cuts[1:], len(block)]):
                yield int(block[start]), int(asks[start]), batch.slice(start, end - start)

    def matrix(lists: list[pa.ListArray]) -> np.ndarray:
        """Vectors as rows; shorter ones are filled up with zeros."""
        out, at = np.zeros((sum(map(len, lists)), width), np.int64), 0
        for part in lists:
            sizes = pc.list_value_length(part).to_numpy()
            out[at : at + len(part)][np.arange(width) < sizes[:, None]] = part.flatten().to_numpy()
            at += len(part)
        return out

    def columns(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Table]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return matrix(table.column("x").chunks), table.drop_columns(["x", "block", "asks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for block, asks, part in runs(batches):
            if block != at:
                at, held, index = block, [], None
            if not asks:
                held.append(part)
                continue
            if index is None and held:
                index, held = build(*columns(held)), []
            for start in range(0, part.num_rows if index is not None else 0, step):
                found = search(index, *columns([part.slice(start, step)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, arrow)], schema=arrow)

    arrow = pa.schema([(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64()) for f in schema.fields])
    return both.mapInArrow(run, schema)


def best_first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]
