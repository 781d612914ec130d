"""Export of a reviewed table: the cleaned copy and its audit log, published together."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.files import Files, part_digests
from assay.functions.scratch import settled
from assay.operators import review
from assay.sources.sinks import publish_together, write_json

STAMP = re.compile(r"\d{8}-\d{6}(?:-\d+)?")
EXPORT_FILES = {"cleaned.csv", "audit-log.json"}


#: Rows of which single files are made on the driver.
MOST_ROWS = 1_000_000
CSV = {"escape": '"', "emptyValue": "", "nullValue": ""}


class OverwriteRefused(ValueError):
    """An output would take the place of a source."""


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 16):
            digest.update(part)
    return digest.hexdigest()


def same_file(a: str, b: str) -> bool:
    if os.path.realpath(a) == os.path.realpath(b):
        return True
    return os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b)


def refuse_overwrite(outputs: list[str], original: str | None) -> None:
    if len(outputs) == 2 and same_file(*outputs):
        raise OverwriteRefused("both outputs are the same file")
    for out in outputs if original else []:
        if same_file(out, original):
            raise OverwriteRefused(f"{out} is the source")
        if os.path.isdir(original) and os.path.commonpath([os.path.realpath(original), os.path.realpath(out)]) == os.path.realpath(original):
            raise OverwriteRefused(f"{out} lies inside the source folder")


def csv_lines(df: DataFrame) -> DataFrame:
    """One column of CSV lines, quoted where need be; a null is an empty field."""
    return df.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), CSV).alias("line"))


def header_line(columns: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if re.search(r'[",\n]', c) else c for c in columns)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file in the order of source_index: partition by partition, lines that Spark has made pass the driver."""
    ordered = df.orderBy("source_index").drop("source_index")
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(header_line(ordered.columns) + "\n")
        for row in csv_lines(ordered).toLocalIterator():
            out.write(row["line"] + "\n")


def export_review(df: DataFrame, label: str, decisions: DataFrame, cleaned_path: str, log_path: str, original_path: str | None = None, meta: dict | None = None, most_rows: int = MOST_ROWS) -> dict:
    """Apply decisions to df (with source_index) and publish the cleaned CSV file and the log, or neither.

    Decisions are checked before anything is written; the source file must be the same before and after. This form
    makes single files on the driver, for up to most_rows rows; export_parts has no such limit.
    """
    refuse_overwrite([cleaned_path, log_path], original_path)
    review.check_decisions(decisions)
    is_file = bool(original_path) and os.path.isfile(original_path)
    before = file_sha256(original_path) if is_file else None
    rows = settled(review.decided(df, decisions))
    counts = review.export_counts(rows).first().asDict()
    if counts["n_in"] > most_rows:
        raise ValueError(f"more than {most_rows} rows: export them as parts")
    entries = (r.asDict() for r in review.audit_log(rows, label).orderBy("source_index").toLocalIterator())
    log = {"label": label, "counts": counts, "source": original_path, "source_sha256": before, "images_modified": False, "meta": meta or {}, "entries": list(entries)}

    def put_log(path: str) -> None:
        after = file_sha256(original_path) if is_file else None
        if after != before:
            raise RuntimeError("the source changed during the export")
        write_json(path, log | {"source_sha256_after": after})

    publish_together({cleaned_path: lambda p: write_csv(review.cleaned(rows, label), p), log_path: put_log})
    return counts


def source_digest(spark: SparkSession, path: str) -> str:
    """A digest of a file or of all files of a folder, of any size: their names and lengths, and sums of the hashes of
    their lines. Any line changed, put in or removed changes it; tasks hash, and the driver gets one row."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"), F.sha2("value", 256).alias("h"))
    number = lambda c, at: F.conv(F.substring(c, at, 12), 16, 10).cast("decimal(38,0)")
    sums = lambda c: [F.sum(number(c, at)).alias(f"s{at}") for at in (1, 13, 25)]
    files = lines.groupBy("f").agg(F.max("s").alias("s"), F.count("*").alias("n"), *sums("h"))
    named = files.select(F.sha2(F.concat_ws("|", F.element_at(F.split("f", "/"), -1), "s", "n", "s1", "s13", "s25"), 256).alias("h"))
    total = named.agg(F.count("*").alias("n"), *sums("h")).first()
    return hashlib.sha256("|".join(map(str, total)).encode()).hexdigest()


def refuse_folder(files: Files, folder: str, source: str | None) -> None:
    """An export must not lie in its source, nor hold it, nor be it, nor take the place of anything."""
    if source:
        a, b = files.full(folder), files.full(source)
        if a == b or a.startswith(f"{b}/") or b.startswith(f"{a}/") or (os.path.exists(folder) and os.path.exists(source) and os.path.samefile(folder, source)):
            raise OverwriteRefused(f"{folder} and the source {source} must lie apart")
    if files.exists(folder):
        raise OverwriteRefused(f"{folder} exists")


def export_parts(df: DataFrame, label: str, decisions: DataFrame, folder: str, meta: dict | None = None, source: str | None = None) -> dict:
    """The same for tables of any size: Spark writes cleaned (CSV with headers), audit-log (JSON lines), manifest (the
    digest of each part of both) and summary to a new folder of any file system. Within them rows are sorted by
    source_index from part to part.

    Nothing has the folder's name until all is written and the source, whose digest is taken before and after, has proved
    unchanged: one rename commits the export. If anything fails, what was written goes. check_parts() finds parts that have
    changed since.
    """
    spark = df.sparkSession
    files, staged = Files(spark), f"{folder.rstrip('/')}.staged-{uuid.uuid4().hex}"
    refuse_folder(files, folder, source)
    review.check_decisions(decisions)
    before = source_digest(spark, source) if source else None
    try:
        rows = settled(review.decided(df, decisions))
        counts = review.export_counts(rows).first().asDict()
        review.cleaned(rows, label).orderBy("source_index").drop("source_index").write.options(header=True, **CSV).csv(f"{staged}/cleaned")
        review.audit_log(rows, label).orderBy("source_index").write.option("ignoreNullFields", False).json(f"{staged}/audit-log")
        part_digests(spark, staged).orderBy("part").write.json(f"{staged}/manifest")
        after = source_digest(spark, source) if source else None
        if after != before:
            raise RuntimeError("the source changed during the export")
        summary = {"label": label, "counts": counts, "source": source, "source_digest": before, "source_digest_after": after, "images_modified": False, "meta": meta or {}}
        files.write_text(f"{staged}/summary.json", json.dumps(summary))
        try:
            files.rename(staged, folder)
        except FileExistsError:
            raise OverwriteRefused(f"{folder} exists") from None
    finally:
        files.delete(staged)  # no longer there after the rename
    return counts


def check_parts(spark: SparkSession, folder: str) -> list[str]:
    """Names of the parts of an export that were changed, removed or added since; the first 1000."""
    told = spark.read.schema("part string, bytes long, sha256 string").json(f"{folder}/manifest").alias("t")
    found = part_digests(spark, folder).where(~F.col("part").rlike("^(manifest/|summary[.]json$)")).alias("f")
    both = told.join(found, F.col("t.part") == F.col("f.part"), "full")
    odd = both.where(~F.col("t.sha256").eqNullSafe(F.col("f.sha256")))
    return sorted(r[0] for r in odd.select(F.coalesce("t.part", "f.part")).limit(1000).collect())


def export_stamp(folder: str, now: datetime | None = None) -> str:
    """A folder name by UTC time that is still free."""
    base = (now or datetime.now(timezone.utc)).strftime("%Y%m%d-%H%M%S")
    name, n = base, 2
    while os.path.exists(os.path.join(folder, name)):
        name, n = f"{base}-{n}", n + 1
    return name


def export_file(folder: str, stamp: str, name: str) -> str:
    if not STAMP.fullmatch(stamp) or name not in EXPORT_FILES:
        raise ValueError("no such export")
    return os.path.join(folder, stamp, name)
