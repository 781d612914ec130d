"""Review of findings, and the cleaned table that decisions make."""

from __future__ import annotations

import os
import socket
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.files import Files
from assay.functions.scratch import settled

ACTIONS = ("keep", "relabel", "drop")
PAGE = 8


def filter_findings(findings: DataFrame, given_label: str | None = None, status: str | None = None, query: str | None = None) -> DataFrame:
    """Rows of a class, of a status, and whose row_id contains the query in any case; None filters nothing."""
    if given_label:
        findings = findings.where(F.col("given_label") == given_label)
    if status:
        findings = findings.where(F.col("status") == status)
    if query and query.strip():
        findings = findings.where(F.contains(F.lower("row_id"), F.lit(query.strip().lower())))
    return findings


def page(findings: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """A page of the filtered findings by rank; a number beyond the last page gives the last one.

    A top-k that keeps as many rows as the page is deep: nothing is numbered.
    """
    last = max(-(-findings.count() // size) - 1, 0)
    return findings.orderBy("rank").offset(size * min(max(number, 0), last)).limit(size)


def top(findings: DataFrame, n: int) -> DataFrame:
    return findings.orderBy("rank").limit(n)


def finding(findings: DataFrame, source_index: int) -> DataFrame:
    return findings.where(F.col("source_index") == source_index).limit(1)


DECISION_LOG = "source_index long, action string, new_label string, seq long, writer string"
#: Files of a log from which it is compacted.
MANY_FILES = 64


def record_decision(spark: SparkSession, log: str, source_index: int, action: str = "keep", new_label: str | None = None, writer: str | None = None) -> DataFrame:
    """Append a decision to the Parquet log at a path, and return the log; the last decision on a row holds.

    An unknown action, or a relabel without a label, is an error, and nothing is written. Of the label, blanks at its
    ends go; other actions have none. seq is the time in nanoseconds, so that several reviewers may append; decisions of
    one time are in order of their writers, then of their content.
    """
    row = spark.createDataFrame([(int(source_index), action, new_label)], "source_index long, action string, new_label string")
    return record_decisions(spark, log, row, writer)


def record_decisions(spark: SparkSession, log: str, decisions: DataFrame, writer: str | None = None, seq: int | None = None) -> DataFrame:
    """Append decisions (source_index, action, new_label) of one time and writer, and compact a log of many files."""
    label = F.when(F.col("action") == "relabel", F.trim("new_label"))
    who = writer or f"{socket.gethostname()}:{os.getpid()}"
    rows = decisions.select(F.col("source_index").cast("long").alias("source_index"), "action", label.alias("new_label"), F.lit(seq or time.time_ns()).alias("seq"), F.lit(who).alias("writer"))
    check_decisions(rows)
    rows.coalesce(1).write.mode("append").parquet(log)
    if len(Files(spark).names(log)) >= MANY_FILES:
        compact_log(spark, log)
    return read_log(spark, log)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(DECISION_LOG).parquet(log)


def compact_log(spark: SparkSession, log: str) -> None:
    """Write the last decision on every row as one snapshot beside the files of a log, and remove those.

    Nothing is lost if it is cut off: the snapshot repeats decisions, which changes no last one. Decisions appended
    meanwhile are in files of their own, and stay. A reader of a file that goes must read again.
    """
    files = Files(spark)
    old = [f"{log.rstrip('/')}/{n}" for n in files.names(log)]
    held = settled(_last(spark.read.schema(DECISION_LOG).parquet(*old)))
    held.repartitionByRange("source_index").write.mode("append").parquet(log)
    for path in old:
        files.delete(path)


def export_label(kind: str, columns: list[str], stored: str | None) -> tuple[str, dict]:
    """The label column that an export of a saved audit writes to, and how it was found.

    An audit of a table needs the column that it has stored. The label of image audits is always named label: another
    stored name is put right, and said so.
    """
    if kind != "images":
        if not stored or stored not in columns:
            raise ValueError("the audit has no label column to export")
        return stored, {"status": "stored", "effective_label_column": stored}
    if "label" not in columns:
        raise ValueError("the label of the image audit is not available")
    if stored == "label":
        return "label", {"status": "stored", "effective_label_column": "label"}
    return "label", {"status": "normalized_legacy_image_audit", "stored_label_column": stored or "", "effective_label_column": "label"}


def last_decisions(log: DataFrame) -> DataFrame:
    """The last decision on every row of a log (source_index, action, new_label, seq, and writer if there is one)."""
    return _last(log).select("source_index", "action", "new_label")


def _last(log: DataFrame) -> DataFrame:
    """By seq, then writer, then content: a total order, so that it doesn't matter how the log is read."""
    log = log if "writer" in log.columns else log.withColumn("writer", F.lit(None).cast("string"))
    best = F.max(F.struct("seq", F.coalesce("writer", F.lit("")).alias("by"), "action", "new_label", "writer")).alias("d")
    return log.groupBy("source_index").agg(best).select("source_index", "d.action", "d.new_label", "d.seq", "d.writer")


def check_decisions(decisions: DataFrame) -> None:
    """Known actions, and a new label wherever one is set."""
    unknown = ~F.coalesce(F.col("action"), F.lit("")).isin(*ACTIONS)
    empty = (F.col("action") == "relabel") & (F.length(F.trim(F.coalesce("new_label", F.lit("")))) == 0)
    bad = decisions.select("source_index", unknown.alias("unknown"), empty.alias("empty")).where("unknown or empty").first()
    if bad:
        raise ValueError(f"row {bad['source_index']}: " + ("unknown action" if bad["unknown"] else "a new label is needed"))


def decided(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every row with its action and new_label; rows without a decision are kept, decisions without a row go."""
    d = decisions.select("source_index", "action", F.trim("new_label").alias("new_label"))
    return df.join(d, "source_index", "left").withColumn("action", F.coalesce("action", F.lit("keep")))


def cleaned(rows: DataFrame, label: str) -> DataFrame:
    """The decided rows without the dropped ones, with new labels, in the columns of the source."""
    # a new label that the column's type cannot hold makes the column a text
    kind = dict(rows.dtypes)[label]
    if kind != "string" and rows.where((F.col("action") == "relabel") & F.col("new_label").try_cast(kind).isNull()).isEmpty():
        value = F.when(F.col("action") == "relabel", F.col("new_label").try_cast(kind)).otherwise(F.col(f"`{label}`"))
    else:
        value = F.when(F.col("action") == "relabel", F.col("new_label")).otherwise(F.col(f"`{label}`").cast("string"))
    out = rows.where("action <> 'drop'").withColumn(label, value)
    return out.drop("action", "new_label")


def audit_log(rows: DataFrame, label: str) -> DataFrame:
    """One entry a source row: its label, the action, and the label that was exported (null if dropped)."""
    old = F.col(f"`{label}`").cast("string")
    new = F.when(F.col("action") == "relabel", F.col("new_label")).when(F.col("action") == "keep", old)
    return rows.select("source_index", old.alias("original_label"), "action", new.alias("exported_label"))


def export_counts(rows: DataFrame) -> DataFrame:
    n = lambda a: F.coalesce(F.sum((F.col("action") == a).cast("long")), F.lit(0))
    return rows.agg(
        F.count("*").alias("n_in"), (F.count("*") - n("drop")).alias("n_out"), n("drop").alias("n_dropped"), n("relabel").alias("n_relabeled"), n("keep").alias("n_kept")
    )
