"""Provenance of an audit: what it read, how it ran, and what it must not be used for."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import platform
import subprocess

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.labels import in_order
from assay.plans.export import MOST_ROWS, file_sha256

SCHEMA = "assay.oof-provenance/v1"


def json_sha256(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row: values as text, null apart from the empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in columns]), 256)


def content_hash(df: DataFrame, order: str = "source_index", fan_in: int = 1000) -> DataFrame:
    """One row (content_sha256): of the names and the root of a hash tree over all rows.

    Rows are hashed, then stretches of fan_in numbers of `order` (0 and up, each once), then fan_in of those, until one is
    left: no group at any level holds more than fan_in hashes. Empty stretches are left out.
    """
    columns = [c for c in df.columns if c != order]
    level = df.select(F.col(order).cast("long").alias("o"), row_hash(columns).alias("h"))
    last = df.agg(F.max(order)).first()[0]
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "\n")
    while True:
        level = level.groupBy(F.floor(F.col("o") / fan_in).alias("g")).agg(F.sha2(lines, 256).alias("h")).withColumnRenamed("g", "o")
        last = (last or 0) // fan_in
        if not last:
            break
    root = level.agg(F.coalesce(F.max("h"), F.lit("")).alias("h"))  # of one row, or none
    return root.select(F.sha2(F.concat(F.lit(",".join(columns)), F.lit("\n"), F.col("h")), 256).alias("content_sha256"))


def table_source(df: DataFrame, path: str | None = None) -> dict:
    out = {"kind": "table", "n_rows": df.count(), "columns": [c for c in df.columns if c != "source_index"], "content_sha256": content_hash(df).first()[0]}
    return out | ({"file": os.path.basename(path), "file_sha256": file_sha256(path)} if path and os.path.isfile(path) else {})


def image_source(files: DataFrame) -> dict:
    """Of rows (image_path, label, content): names, labels and bytes in order of label and name."""
    named = files.select(F.element_at(F.split("image_path", "/"), -1).alias("name"), "label", F.sha2("content", 256).alias("sha256"))
    numbered = in_order(named, [F.asc("label"), F.asc("name")], "source_index")
    return {"kind": "images", "n_rows": numbered.count(), "content_sha256": content_hash(numbered).first()[0]}


def project_revision(folder: str | None = None) -> str | None:
    try:
        done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder or os.path.dirname(__file__), capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def dependency_versions(names: tuple[str, ...] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict[str, str]:
    def version(name: str) -> str:
        try:
            return importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            return "not-installed"

    return {n: version(n) for n in names}


def manifest(audit, source: dict) -> dict:
    """What an audit's report says about itself."""
    configuration = {"seed": audit.seed, "n_splits": audit.n_splits, "n_neighbors": audit.n_neighbors, "class_order": audit.names, "backend": audit.backend, "kinds": audit.kinds}
    return {
        "schema_version": SCHEMA,
        "purpose": "ranking rows for human review",
        "final_evaluation": {"included": False, "note": "out-of-fold scores rank rows; they are no estimate on unseen data"},
        "source": source,
        "configuration": configuration,
        "configuration_sha256": json_sha256(configuration),
        "runtime": {"python": platform.python_version(), "revision": project_revision(), "dependencies": dependency_versions()},
    }


def report(audit, source: dict, findings: str | None = None, most_rows: int = MOST_ROWS) -> dict:
    """The report of an audit, for a JSON file. More than most_rows findings don't go through the driver: Spark writes
    them as Parquet to the path `findings`, and the report names it. The indices that the cross-check flags are listed
    under the same limit; beyond, the column cross_check of the findings has them."""
    many = audit.findings.count() > most_rows
    if many and not findings:
        raise ValueError(f"more than {most_rows} findings: a path for them is needed")
    if findings:
        audit.findings.write.mode("overwrite").parquet(findings)
    stats = [r.asDict() for r in audit.class_stats.orderBy("class_index").collect()]
    cells = {(r["given_label"], r["confident_label"]): r["n"] for r in audit.joint.collect()}
    check = dict(audit.cross_check)
    if audit.flagged is not None:
        check["n_flagged"] = audit.flagged.count()
        first = audit.flagged.orderBy("self_confidence", "source_index").select("source_index") if check["n_flagged"] <= most_rows else None
        check["flagged_indices"] = [r[0] for r in first.toLocalIterator()] if first is not None else []
    return {
        "class_names": audit.names,
        "thresholds": [s["threshold"] for s in stats],
        "confident_joint": [[cells[a, b] for b in audit.names] for a in audit.names],
        "noise_rates": {s["class_name"]: s["noise_rate"] for s in stats},
        "cross_check": check,
        "n_splits": audit.n_splits,
        "seed": audit.seed,
        "summary": audit.summary().first().asDict(),
        "provenance": manifest(audit, source),
        "findings": findings,
        "rows": [] if many else [r.asDict(recursive=True) for r in audit.findings.orderBy("rank").toLocalIterator()],
    }
