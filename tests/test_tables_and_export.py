"""Kinds, readers, decisions, export, images and the command line."""

import json
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay import cli
from assay.functions import scratch
from assay.operators import labels, preparation, review, scoring
from assay.plans import audit, export, provenance
from assay.sources import images, sinks, store, tables


def test_kinds(spark):
    df = spark.createDataFrame([(1, "oslo", "a long note about the harbour at dusk"), (2, "rome", "another long note about the old bridge"), (3, "oslo", None), (4, None, "a third note, on bread and on butter")], "age int, city string, note string")
    assert preparation.infer_kinds(df) == {"age": "numeric", "city": "categorical", "note": "text"}
    with pytest.raises(ValueError):
        preparation.normalize_kinds({"numeric": ["age"], "text": ["age"]}, ["age"])
    with pytest.raises(ValueError):
        preparation.check_columns(df, "age", [])
    assert preparation.suggest_label(["x", "Label", "y"]) == "Label" and preparation.default_features(["id", "x", "l"], "l", True) == ["x"]


def test_csv_reader(spark, tmp_path):
    (tmp_path / "t.csv").write_text('x,flag,name,none\n1,true,"a, b",\nNA,False,,NA\n3,true,c,\n')
    df = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"x": "bigint", "flag": "boolean", "name": "string", "none": "double", "source_index": "bigint"}
    assert [r["x"] for r in df.orderBy("source_index").collect()] == [1, None, 3]
    (tmp_path / "e.csv").write_text("x,y\n")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "e.csv"))


def test_source_index_over_partitions(spark):
    df = labels.with_source_index(spark.range(0, 100, 1, 7))
    assert all(r["id"] == r["source_index"] for r in df.collect())


def frame(spark):
    """Five shells of a beach survey; the third one's label has a comma, the last one's remark a quote."""
    rows = [(10, "north", "cockle", None), (11, "north", "whelk", "chipped"), (12, "cove", "razor, long", "pair"), (13, "cove", "whelk", ""), (14, "spit", "cockle", 'a "blue" one')]
    return spark.createDataFrame(rows, "source_index long, beach string, shell string, remark string").repartition(3)


DECISIONS = {"10": {"action": "keep"}, "12": {"action": "drop"}, "13": {"action": "relabel", "new_label": "  limpet"}, "14": {"action": "relabel", "new_label": "top, shell "}, "700": {"action": "drop"}}
CLEANED = ["beach,shell,remark", "north,cockle,", "north,whelk,chipped", "cove,limpet,", 'spit,"top, shell","a ""blue"" one"']


def test_export(spark, tmp_path):
    d = tables.decisions_frame(spark, DECISIONS)
    out, log = str(tmp_path / "shells.csv"), str(tmp_path / "shells.json")
    counts = export.export_review(frame(spark), "shell", d, out, log, meta={"by": "ann"})
    assert counts == {"n_in": 5, "n_out": 4, "n_dropped": 1, "n_relabeled": 2, "n_kept": 2}
    assert open(out).read().splitlines() == CLEANED
    told = json.load(open(log))
    assert [(e["source_index"], e["action"], e["exported_label"]) for e in told["entries"]] == [
        (10, "keep", "cockle"), (11, "keep", "whelk"), (12, "drop", None), (13, "relabel", "limpet"), (14, "relabel", "top, shell")
    ]
    assert told["meta"] == {"by": "ann"} and sorted(os.listdir(tmp_path)) == ["shells.csv", "shells.json"]
    with pytest.raises(ValueError, match="parts"):
        export.export_review(frame(spark), "shell", d, out, log, most_rows=4)


def test_export_in_parts(spark, tmp_path):
    d = tables.decisions_frame(spark, DECISIONS)
    folder = str(tmp_path / "parts")
    assert export.export_parts(frame(spark), "shell", d, folder)["n_out"] == 4
    names = sorted(n for n in os.listdir(f"{folder}/cleaned") if n.endswith(".csv"))
    lines = [line for n in names for line in open(f"{folder}/cleaned/{n}").read().splitlines() if line != CLEANED[0]]
    assert lines == CLEANED[1:]
    assert spark.read.json(f"{folder}/audit-log").where("exported_label is null").first()["source_index"] == 12
    with pytest.raises(export.OverwriteRefused):
        export.export_parts(frame(spark), "shell", d, folder)
    assert os.listdir(tmp_path) == ["parts"]


def test_parts_are_guarded(spark, tmp_path, monkeypatch):
    source = tmp_path / "in" / "shells.csv"
    source.parent.mkdir()
    source.write_text("\n".join(CLEANED) + "\n")
    d = tables.decisions_frame(spark, DECISIONS)
    for folder in (str(source), str(source.parent), str(source.parent / "out"), f"file:{tmp_path}/in/../in/shells.csv"):
        with pytest.raises(export.OverwriteRefused):
            export.export_parts(frame(spark), "shell", d, folder, source=str(source.parent))
    folder = str(tmp_path / "out")
    export.export_parts(frame(spark), "shell", d, folder, {"by": "ann"}, str(source))
    told = json.load(open(f"{folder}/summary.json"))
    assert told["source_digest"] == told["source_digest_after"] == export.source_digest(spark, str(source)) and told["images_modified"] is False
    assert export.check_parts(spark, folder) == []
    part = next(n for n in sorted(os.listdir(f"{folder}/cleaned")) if n.endswith(".csv"))
    with open(f"{folder}/cleaned/{part}", "a") as f:
        f.write("more\n")
    (tmp_path / "out" / "cleaned" / "part-added.csv").write_text("x")
    assert export.check_parts(spark, folder) == sorted([f"cleaned/{part}", "cleaned/part-added.csv"])
    before = export.source_digest(spark, str(source))
    decided = review.decided

    def tampering(df, decisions):
        source.write_text(source.read_text().replace("cockle", "cackle"))
        return decided(df, decisions)

    monkeypatch.setattr(review, "decided", tampering)
    with pytest.raises(RuntimeError, match="changed"):
        export.export_parts(frame(spark), "shell", d, str(tmp_path / "late"), source=str(source))
    monkeypatch.setattr(review, "decided", lambda *_: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        export.export_parts(frame(spark), "shell", d, str(tmp_path / "late"), source=str(source))
    assert sorted(os.listdir(tmp_path)) == ["in", "out"] and export.source_digest(spark, str(source)) != before


def test_log_is_compacted(spark, tmp_path):
    """Thousands of decisions of several writers, in any order of appends: few files, the same last decisions."""
    r = np.random.default_rng(3)
    batches = []
    for b in range(24):
        rows = [(int(i), a, "x" if a == "relabel" else None) for i, a in zip(r.integers(0, 900, 420), r.choice(["keep", "drop", "relabel"], 420))]
        batches.append((rows, int(r.integers(1, 6)), f"writer {b % 4}"))
    last = {}
    for rows, seq, who in batches:
        for i, a, label in rows:
            last[i] = max(last.get(i, (0, "", "", "")), (seq, who, a, label or ""))
    for order in (range(24), r.permutation(24)):
        log = str(tmp_path / f"log{order[1]}")
        for n, b in enumerate(order):
            rows, seq, who = batches[b]
            review.record_decisions(spark, log, spark.createDataFrame(rows, "source_index long, action string, new_label string"), who, seq)
            if n in (9, 17):
                review.compact_log(spark, log)
        review.compact_log(spark, log)
        assert len([n for n in os.listdir(log) if n.endswith(".parquet")]) <= 4
        got = {x["source_index"]: (x["action"], x["new_label"] or "") for x in review.last_decisions(review.read_log(spark, log)).collect()}
        assert got == {i: v[2:] for i, v in last.items()} and review.read_log(spark, log).count() == len(last)


def test_kinds_near_the_thresholds(spark):
    """Numbers of distinct values just below, at and above 40 and half of the rows."""
    for n in (60, 3000):
        many = max(40, n // 2)
        rows = [tuple(f"value-{min(i, d - 1):05d}" for d in (many - 1, many, many + 1, 3, n)) for i in range(n)]
        df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
        assert preparation.infer_kinds(df) == {"a": "categorical", "b": "categorical", "c": "text", "d": "categorical", "e": "text"}
    wide = spark.createDataFrame([tuple(f"value-{i % 3}" for _ in range(6))  for i in range(300)], ", ".join(f"c{j} string" for j in range(6)))
    assert set(preparation.infer_kinds(wide).values()) == {"categorical"}
    assert "Expand" not in preparation.kind_statistics(wide, wide.columns)._jdf.queryExecution().executedPlan().toString()


def test_decisions_are_appended(spark, tmp_path):
    log = str(tmp_path / "log")
    for action, label in (("drop", None), ("relabel", " conch "), ("keep", "unused")):
        review.record_decision(spark, log, 4, action, label)
    review.record_decision(spark, log, 9, "relabel", "conch ")
    with pytest.raises(ValueError):
        review.record_decision(spark, log, 4, "relabel", "  ")
    with pytest.raises(ValueError):
        review.record_decision(spark, log, 4, "burn")
    last = review.last_decisions(spark.read.parquet(log)).orderBy("source_index").collect()
    assert [tuple(r) for r in last] == [(4, "keep", None), (9, "relabel", "conch")]


def test_label_of_an_export():
    assert review.export_label("table", ["a", "b"], "b")[0] == "b" and review.export_label("images", ["path", "label"], "label")[1]["status"] == "stored"
    assert review.export_label("images", ["path", "label"], None)[1]["stored_label_column"] == ""
    for kind, columns, stored in (("table", ["a"], "b"), ("table", ["a"], None), ("images", ["path"], "label")):
        with pytest.raises(ValueError):
            review.export_label(kind, columns, stored)


def test_stored_dataset(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i}", float(i), "ab"[i % 2] if i else None) for i in range(9)], "file string, size double, class string")
    meta = store.store_table(df, str(tmp_path))
    assert meta["suggested_label"] == "class" and meta["suggested_features"] == ["size"] and len(meta["preview"]) == 6 and meta["n_rows"] == 9
    assert [c["sample"] for c in meta["columns"]] == [["p0", "p1", "p2"], ["0.0", "1.0", "2.0"], ["", "b", "a"]] and meta["class_sample"] == ["a", "b"]
    rows, again = store.load_dataset(spark, str(tmp_path), meta["dataset_id"])
    assert again == json.loads(json.dumps(meta)) and [r["file"] for r in rows.orderBy("source_index").collect()] == [f"p{i}" for i in range(9)]
    with pytest.raises(ValueError):
        store.load_dataset(spark, str(tmp_path), "../x")


def test_export_refuses_and_rolls_back(spark, tmp_path):
    src = tmp_path / "src.csv"
    src.write_text("label\nx\n")
    os.link(src, tmp_path / "same.csv")
    d = tables.decisions_frame(spark, DECISIONS)
    for a, b in ((src, "l.json"), ("same.csv", "l.json"), ("o.csv", "o.csv")):
        with pytest.raises(export.OverwriteRefused):
            export.export_review(frame(spark), "shell", d, str(tmp_path / a), str(tmp_path / b), str(src))
    with pytest.raises(ValueError):
        export.export_review(frame(spark), "shell", tables.decisions_frame(spark, {"10": {"action": "relabel", "new_label": " "}}), str(tmp_path / "o.csv"), str(tmp_path / "l.json"))
    old = tmp_path / "old.txt"
    old.write_text("old")

    def fails(path):
        raise OSError("full")

    with pytest.raises(OSError):
        sinks.publish_together({str(old): lambda p: open(p, "w").write("new"), str(tmp_path / "b"): fails})
    assert old.read_text() == "old" and not [n for n in os.listdir(tmp_path) if n.endswith((".new", ".old"))]
    with pytest.raises(ValueError):
        export.export_file(str(tmp_path), "../x", "cleaned.csv")


def test_last_decision_wins(spark):
    log = spark.createDataFrame([(1, "keep", None, 1), (1, "drop", None, 2)], "source_index long, action string, new_label string, seq long")
    assert review.last_decisions(log).first()["action"] == "drop"


def test_plain_json_values():
    assert sinks.plain({"a": float("nan"), 1: (np.float64(2.0), np.array([1]))}) == {"a": None, "1": [2.0, [1]]}


def test_unsafe_archive(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        sinks.extract_zip(str(tmp_path / "a.zip"), str(tmp_path / "out"))


def turned(png_data: bytes, how: int) -> bytes:
    """The PNG file with an EXIF chunk that states an orientation."""
    tiff = b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, how, 0, 0)
    chunk = struct.pack(">I", len(tiff)) + b"eXIf" + tiff + struct.pack(">I", zlib.crc32(b"eXIf" + tiff))
    return png_data[:33] + chunk + png_data[33:]


def test_images(spark, tmp_path):
    root = images.materialize_shapes(str(tmp_path / "pics"), 6)
    (tmp_path / "pics" / "disc" / "notes.txt").write_text("no image")
    (tmp_path / "pics" / "disc" / ".hidden.png").write_bytes(b"?")
    df = images.image_features(spark, root).cache()
    assert df.count() == 12 and images.LENGTH == 2044 and df.where(F.size("features") != 2044).isEmpty()
    records = tables.image_records(spark, root)
    assert len(records) == 12
    found = audit.audit_images(images.image_features(spark, records), n_splits=3)
    rows = found.findings.orderBy("source_index").collect()
    assert [r["source_index"] for r in rows] == list(range(12)) and rows[0]["image_path"].endswith("disc/disc-000.png")
    assert provenance.image_source(images.read_images(spark, root))["content_sha256"] == provenance.image_source(images.read_images(spark, records))["content_sha256"]
    (tmp_path / "pics" / "disc" / "broken.png").write_bytes(b"\x89PNG nothing")
    with pytest.raises(Exception, match="broken.png"):
        images.image_features(spark, root).count()


def test_manifest_of_a_long_list(spark, tmp_path):
    """100,000 listed paths, written in many ways, are read as a table and joined with Spark's listing."""
    root = images.materialize_shapes(str(tmp_path / "pics"), 5)
    ways = ["pics/{0}", "pics//./{0}", "pics/disc/../{0}", f"{root}/{{0}}", f"file:{root}/{{0}}", f"file://{root}/{{0}}"]
    names = [f"{c}/{c}-{i:03d}.png" for c in ("disc", "tile") for i in range(5)]
    with open(tmp_path / "list.csv", "w") as f:
        f.write("n,File,Class\n" + "".join(f'{i},{ways[i % 6].format(names[i % 10])},"{"a,b" if i % 3 else ""}"\n' for i in range(100_000)))
    found = images.image_manifest(spark, str(tmp_path / "list.csv"))
    assert "LocalTableScan" not in found._jdf.queryExecution().executedPlan().toString()
    counts = {(r["image_path"], r["label"]): r["count"] for r in found.groupBy("image_path", "label").count().collect()}
    assert sum(counts.values()) == 100_000 and {p for p, _ in counts} == {f"{root}/{n}" for n in names} and {c for _, c in counts} == {"a,b", "nan"}
    few = found.dropDuplicates(["image_path"])
    assert images.image_features(spark, few).count() == 10
    with open(tmp_path / "list.csv", "a") as f:
        f.write("1,pics/disc/gone.png,a\n")
    with pytest.raises(FileNotFoundError, match="gone"):
        images.image_manifest(spark, str(tmp_path / "list.csv"))
    for text in ("x,Class\na,b\n", "path,label\n"):
        (tmp_path / "list.csv").write_text(text)
        with pytest.raises(ValueError):
            images.image_manifest(spark, str(tmp_path / "list.csv"))
    with pytest.raises(FileNotFoundError):
        images.image_manifest(spark, str(tmp_path / "nothing"))


def test_thumbnails(spark, tmp_path):
    root = images.materialize_shapes(str(tmp_path / "pics"), 2)
    small = images.thumbnails(spark, images.image_manifest(spark, root), 16).collect()
    assert len(small) == 4 and {r["label"] for r in small} == {"disc", "tile"}
    for r in small:
        (tmp_path / "t" / r["label"]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / r["label"] / os.path.basename(r["image_path"])).write_bytes(r["png"])
    again = spark.read.format("image").load(f"{tmp_path}/t/*/*").select("image.height", "image.width", "image.data", "image.origin").collect()
    whole = {os.path.basename(r["origin"]): r for r in spark.read.format("image").load(f"{root}/*/*").select("image.height", "image.width", "image.data", "image.origin").collect()}
    for r in again:
        big = whole[os.path.basename(r["origin"])]
        pixels = np.frombuffer(big["data"], np.uint8).reshape(big["height"], big["width"], 3)
        assert (r["height"], r["width"]) == (16, 16)
        assert (np.frombuffer(r["data"], np.uint8).reshape(16, 16, 3) == np.rint(images.resize(pixels, 16, 16))).all()


def test_images_are_upright(spark, tmp_path):
    picture = np.random.default_rng(4).integers(0, 255, (40, 64, 3), np.uint8)
    ways = {
        1: picture, 2: np.fliplr(picture), 3: np.rot90(picture, 2), 4: np.flipud(picture), 5: picture.transpose(1, 0, 2),
        6: np.rot90(picture, -1), 7: np.rot90(picture, 2).transpose(1, 0, 2), 8: np.rot90(picture),
    }
    for how, seen in ways.items():
        assert (images.upright(picture, how) == seen).all() and images.orientation(turned(images.png(picture), how)) == how
        (tmp_path / f"{how}.png").write_bytes(turned(images.png(picture), how))
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 34) + b"Exif\0\0MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, 6, 0, 0) + b"\xff\xda"
    assert images.orientation(jpeg) == 6 and images.orientation(b"") == images.orientation(images.png(picture)) == images.orientation(b"\xff\xd8\xff\xe1\0\2") == 1
    (tmp_path / "list.csv").write_text("Path,Class\n" + "".join(f"{how}.png,{'ab'[how % 2]}\n" for how in ways) + "1.png,b\n")
    records = tables.image_records(spark, str(tmp_path / "list.csv"))
    got = images.image_features(spark, records).collect()
    assert len(got) == 9 and sorted(r["label"] for r in got if r["image_path"].endswith("/1.png")) == ["b", "b"]
    for r in got:
        assert np.allclose(r["features"], images.classic_features(ways[int(r["image_path"][-5])]))


def test_command_line(spark, tmp_path):
    rows = [f"{i % 2 * 5 + i / 10},{i % 2 * 4 - i / 9},{'ab'[i % 2]}" for i in range(12)]
    (tmp_path / "in.csv").write_text("x,y,label\n" + "\n".join(rows) + "\n")
    assert cli.main(["audit", "--csv", str(tmp_path / "in.csv"), "--label", "label", "--out", str(tmp_path / "r.json")], spark) == 0
    report = json.load(open(tmp_path / "r.json"))
    assert len(report["rows"]) == 12 and report["provenance"]["final_evaluation"]["included"] is False
    assert abs(sum(report["rows"][0]["oof_probabilities"].values()) - 1) < 1e-9
    with pytest.raises(export.OverwriteRefused):
        cli.main(["audit", "--csv", str(tmp_path / "in.csv"), "--out", str(tmp_path / "in.csv")], spark)
    (tmp_path / "d.json").write_text(json.dumps({"rows": [{"source_index": 0, "action": "drop"}]}))
    cli.main(["export", "--source", str(tmp_path / "in.csv"), "--label", "label", "--decisions", str(tmp_path / "d.json"), "--out", str(tmp_path / "c.csv"), "--log", str(tmp_path / "l.json")], spark)
    assert len(open(tmp_path / "c.csv").read().splitlines()) == 12


def test_audit_of_an_archive_of_images(spark, tmp_path):
    root = images.materialize_shapes(str(tmp_path / "pics"), 4)
    with zipfile.ZipFile(tmp_path / "pics.zip", "w") as z:
        for label in ("disc", "tile"):
            for n in os.listdir(f"{root}/{label}"):
                z.write(f"{root}/{label}/{n}", f"top/{label}/{n}")
    out, rows = str(tmp_path / "r.json"), str(tmp_path / "findings")
    assert cli.main(["audit", "--images", str(tmp_path / "pics.zip"), "--folds", "2", "--out", out, "--findings", rows], spark) == 0
    assert len(json.load(open(out))["rows"]) == spark.read.parquet(rows).count() == 8


def test_scratch_tables_go_with_their_scope(spark, tmp_path):
    folder = scratch.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch.scratch_scope(spark):
        kept = scratch.settled(spark.range(5))
        with scratch.scratch_scope(spark):
            scratch.settled(spark.range(5))
            assert len(set(os.listdir(folder)) - before) == 2
        assert kept.count() == 5 and len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before
    (tmp_path / "in.csv").write_text("x,label\n" + "".join(f"{i},{'ab'[i % 2]}\n" for i in range(12)))
    cli.main(["audit", "--csv", str(tmp_path / "in.csv"), "--out", str(tmp_path / "r.json"), "--cross-check"], spark)
    assert set(os.listdir(folder)) == before and json.load(open(tmp_path / "r.json"))["cross_check"]["available"]

    class Cluster:  # a session whose machines share nothing
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_folder(Cluster)


def test_large_tables_are_numbered_whole(spark):
    """Sorted tables of some MB, which adaptive plans cut by what a job reads."""
    wide = spark.range(60_000).select(
        F.col("id").alias("source_index"), F.floor(F.rand(3) * 500).alias("ensemble_score"), F.lit(0.0).alias("cl_score"), F.array_repeat(F.rand(5), 40).alias("more")
    )
    ranked = scoring.ranked(wide).select("rank", "ensemble_score", "source_index").toPandas().sort_values("rank")
    assert list(ranked["rank"]) == list(range(1, 60_001))
    assert list(ranked.sort_values(["ensemble_score", "source_index"], ascending=[False, True])["rank"]) == list(range(1, 60_001))
    vectors = spark.range(2000).select(F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("image_path"), (F.col("id") % 3).cast("string").alias("label"), F.array_repeat(F.rand(1), 2044).alias("features"))
    numbered = labels.in_order(vectors, [F.asc("label"), F.asc("image_path")], "source_index").select("source_index").collect()
    assert sorted(r[0] for r in numbered) == list(range(2000))


def test_numbers_as_text(spark):
    values = [0.0, -0.0, 1.0, -2.5, 1e7, 12345678.9, 123456789012345.6, 9007199254740993.0, 1e16, 1.5e16, -1.5e22, 1e-3, 1e-4, 1.5e-4, 1e-5, 2.5e-7, 1e100, 5e-324, float("inf"), float("-inf"), float("nan"), 0.1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["t"] for r in df.select("i", labels.python_number(F.col("v")).alias("t")).orderBy("i").collect()]
    # Java may write more digits than the shortest decimal has
    assert [g for g, v in zip(got, values) if v != 5e-324] == [str(v) for v in values if v != 5e-324]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert labels.class_names(flags, "b") == ["False", "True", "nan"]
    with pytest.raises(ValueError, match="classes"):
        labels.class_names(spark.range(labels.MOST_CLASSES + 1), "id")
