"""Tables written once and read many times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from assay.functions.files import Files

#: The tables of the scopes that are open, innermost last.
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder of the session. A local session without either gets a temporary one,
    which goes with it; on a cluster, whose machines share no such folder, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        path = tempfile.mkdtemp(prefix="spark-assay-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def new_table(spark: SparkSession, stem: str) -> str:
    """A path for a table; where a scope is open, the table goes when that ends."""
    path = f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Within it, tables are written as ever; at its end they are removed. Nothing that is still to be computed may read
    them then: results are written, or collected, before."""
    _scopes.append([])
    try:
        yield
    finally:
        files = Files(spark)
        for path in _scopes.pop():
            files.delete(path)


def settled(df: DataFrame) -> DataFrame:
    """df as a written table: its rows are computed once, and every later job sees the same ones in the same parts."""
    path = new_table(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
