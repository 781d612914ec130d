"""Stored datasets: a table with its row numbers as Parquet, and a description for whoever chooses what to audit."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.files import Files
from assay.operators import labels, preparation
from assay.sources.sinks import plain

ID = re.compile(r"[0-9a-f]{12}")
# Rows of a preview and samples of a column.
PREVIEW_ROWS, SAMPLES = 6, 3


def describe(df: DataFrame, label: str | None = None) -> dict:
    """Columns with kind and samples of their first rows, a preview, the suggested label and features, and classes.

    Rows are in the order of source_index; besides the statistics of the kinds only some rows reach the driver.
    """
    own = [c for c in df.columns if c != "source_index"]
    label = label or preparation.suggest_label(own)
    kinds = preparation.infer_kinds(df, own)
    first = [r.asDict(recursive=True) for r in df.orderBy("source_index").limit(PREVIEW_ROWS).collect()]
    text = lambda v: "" if v is None else str(v)
    return {
        "n_rows": df.count(),
        "columns": [{"name": c, "kind": kinds[c], "sample": [text(r[c]) for r in first[:SAMPLES]]} for c in own],
        "preview": [plain({c: r[c] for c in own}) for r in first],
        "suggested_label": label,
        "suggested_features": preparation.default_features(own, label, skip_ids=True),
        "class_sample": [r["class_name"] for r in labels.class_sample(df, label).collect()],
    }


def store_table(df: DataFrame, folder: str, kind: str = "table", original_path: str | None = None, label: str | None = None) -> dict:
    """Write df, with source_index (added if there is none), under a new id below folder; returns its description."""
    df = df if "source_index" in df.columns else labels.with_source_index(df)
    dataset_id = uuid.uuid4().hex[:12]
    path = f"{folder}/datasets/{dataset_id}"
    df.write.parquet(f"{path}/source")
    meta = {"dataset_id": dataset_id, "kind": kind, "original_path": original_path} | describe(df.sparkSession.read.parquet(f"{path}/source"), label)
    if kind == "images":
        meta["suggested_features"] = []
    Files(df.sparkSession).write_text(f"{path}/meta.json", json.dumps(plain(meta), indent=2, ensure_ascii=False))
    return meta


def store_images(spark: SparkSession, records: DataFrame | list[tuple[str, str]], folder: str, original_path: str | None = None) -> dict:
    """A dataset of listed images (see images.image_manifest): columns path and label."""
    rows = records.toDF("path", "label") if isinstance(records, DataFrame) else spark.createDataFrame(records, "path string, label string")
    return store_table(labels.in_order(rows, [F.asc("label"), F.asc("path")], "source_index"), folder, "images", original_path, "label")


def load_dataset(spark: SparkSession, folder: str, dataset_id: str) -> tuple[DataFrame, dict]:
    """The rows and the description of a stored dataset."""
    if not ID.fullmatch(dataset_id or ""):
        raise ValueError("unknown dataset")
    path = f"{folder}/datasets/{dataset_id}"
    return spark.read.parquet(f"{path}/source"), json.loads(Files(spark).read_text(f"{path}/meta.json"))
