"""Command line: audit, benchmark and export."""

from __future__ import annotations

import argparse
import sys
import tempfile

from pyspark.sql import SparkSession

from assay.functions.files import Files
from assay.functions.scratch import new_table, scratch_scope
from assay.operators import review
from assay.plans import audit, benchmark, export, provenance
from assay.sources import images, sinks, store, tables


def session() -> SparkSession:
    return SparkSession.builder.appName("assay").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="assay")
    commands = p.add_subparsers(dest="command", required=True)
    a = commands.add_parser("audit")
    source = a.add_mutually_exclusive_group(required=True)
    source.add_argument("--csv")
    source.add_argument("--images")
    a.add_argument("--label")
    a.add_argument("--features", nargs="*")
    for name, value in (("seed", 42), ("folds", 5), ("neighbors", 5)):
        a.add_argument(f"--{name}", type=int, default=value)
    a.add_argument("--out", required=True)
    a.add_argument("--findings", help="a path for the findings as Parquet")
    a.add_argument("--cross-check", action="store_true", help="also flag rows by confident learning")
    v = commands.add_parser("preview")
    v.add_argument("--csv", required=True)
    v.add_argument("--out", required=True)
    d = commands.add_parser("decide")
    d.add_argument("--decisions-log", required=True)
    d.add_argument("--row", type=int, required=True)
    d.add_argument("--action", default="keep")
    d.add_argument("--new-label")
    b = commands.add_parser("benchmark")
    b.add_argument("--seed", type=int, default=42)
    b.add_argument("--output")
    b.add_argument("--markdown")
    e = commands.add_parser("export")
    for name in ("source", "label", "decisions", "out"):
        e.add_argument(f"--{name}", required=True)
    e.add_argument("--log", help="the log's file; without it, --out is a folder of parts for tables of any size")
    return p


def unpacked(spark: SparkSession, archive: str) -> str:
    """The top folder of an archive's images, in the shared folder."""
    with tempfile.TemporaryDirectory() as here:
        top = sinks.extract_zip(archive, here)
        path = new_table(spark, "images")
        Files(spark).put(top, path)
    return path


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    with scratch_scope(spark):  # whatever a command writes on its way goes with it
        return run(args, spark)


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "audit":
        export.refuse_overwrite([args.out], args.csv or args.images)
        options = {"n_splits": args.folds, "n_neighbors": args.neighbors, "seed": args.seed, "cross_check": args.cross_check}
        if args.csv:
            df = tables.read_csv(spark, args.csv)
            label = args.label or audit.preparation.suggest_label([c for c in df.columns if c != "source_index"])
            found = audit.audit_table(df, label, args.features, **options)
            source = provenance.table_source(df, args.csv)
        else:
            root = args.images
            if root.lower().endswith(".zip"):  # executors read the files as well
                root = unpacked(spark, root)
            records = images.image_manifest(spark, root)
            found = audit.audit_images(images.image_features(spark, records), **options)
            source = provenance.image_source(images.read_images(spark, records))
        sinks.write_json(args.out, provenance.report(found, source, args.findings))
    elif args.command == "preview":
        sinks.write_json(args.out, store.describe(tables.read_csv(spark, args.csv)))
    elif args.command == "decide":
        review.record_decision(spark, args.decisions_log, args.row, args.action, args.new_label)
    elif args.command == "benchmark":
        report = benchmark.run_benchmark(spark, args.seed, progress=lambda s: print(s, file=sys.stderr))
        if args.output:
            sinks.write_json(args.output, report)
        text = benchmark.markdown_table(report)
        if args.markdown:
            with open(args.markdown, "w", encoding="utf-8") as f:
                f.write(text)
        print(text)
    else:
        df = tables.read_csv(spark, args.source)
        decisions = review.last_decisions(spark.read.parquet(args.decisions)) if not args.decisions.endswith(".json") else tables.read_decisions(spark, args.decisions)
        if args.log:
            print(export.export_review(df, args.label, decisions, args.out, args.log, args.source))
        else:
            print(export.export_parts(df, args.label, decisions, args.out, source=args.source))
    return 0


if __name__ == "__main__":
    sys.exit(main())
