"""Features of images: colour histogram, grey thumbnail and oriented gradients, in numpy within tasks."""

from __future__ import annotations

import posixpath
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.files import Files
from assay.functions.scratch import settled

# Fixed values of the feature vector.
SIDE, THUMB, BINS, ORIENTATIONS, CELL = 64, 16, 8, 9, 8
LENGTH = 3 * BINS + THUMB * THUMB + (SIDE // CELL - 1) ** 2 * 4 * ORIENTATIONS
LUMA = np.array([0.299, 0.587, 0.114])


def resize(rgb: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling, pixel centres aligned."""

    def places(n: int, m: int):
        at = ((np.arange(m) + 0.5) * n / m - 0.5).clip(0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = places(rgb.shape[0], height)
    x0, x1, fx = places(rgb.shape[1], width)
    fy, fx = fy[:, None, None], fx[None, :, None]
    rgb = rgb.astype(float)
    above = rgb[y0][:, x0] * (1 - fx) + rgb[y0][:, x1] * fx
    below = rgb[y1][:, x0] * (1 - fx) + rgb[y1][:, x1] * fx
    return above * (1 - fy) + below * fy


def color_histogram(rgb: np.ndarray) -> np.ndarray:
    at = np.minimum(rgb.astype(int) * BINS // 256, BINS - 1)
    counts = np.concatenate([np.bincount(at[..., c].ravel(), minlength=BINS) for c in range(3)]).astype(float)
    return counts / max(counts.sum(), 1.0)


def thumbnail(rgb: np.ndarray) -> np.ndarray:
    return (resize(rgb, THUMB, THUMB) @ LUMA / 255.0).ravel()


def gradients(rgb: np.ndarray) -> np.ndarray:
    """Histograms of unsigned gradient angles in cells, each vote shared by two bins, blocks of 2 x 2 normalised."""
    grey = rgb @ LUMA / 255.0
    dy, dx = np.gradient(grey)
    size, angle = np.hypot(dx, dy), np.degrees(np.arctan2(dy, dx)) % 180.0
    at = angle / (180.0 / ORIENTATIONS)
    low = np.floor(at).astype(int) % ORIENTATIONS
    share = at - np.floor(at)
    votes = np.zeros((*grey.shape, ORIENTATIONS))
    y, x = np.indices(grey.shape)
    np.add.at(votes, (y, x, low), size * (1 - share))
    np.add.at(votes, (y, x, (low + 1) % ORIENTATIONS), size * share)
    n = grey.shape[0] // CELL
    cells = votes.reshape(n, CELL, n, CELL, ORIENTATIONS).sum(axis=(1, 3))
    blocks = np.stack([cells[i : n - 1 + i, j : n - 1 + j] for i in (0, 1) for j in (0, 1)], axis=2).reshape(n - 1, n - 1, -1)
    return (blocks / (np.sqrt((blocks**2).sum(axis=-1, keepdims=True)) + 1e-6)).ravel()


def classic_features(rgb: np.ndarray) -> np.ndarray:
    small = np.rint(resize(rgb, SIDE, SIDE)).clip(0, 255)
    return np.concatenate([color_histogram(small), thumbnail(small), gradients(small)])


def png(rgb: np.ndarray) -> bytes:
    """A PNG file of an 8-bit picture, grey or of three channels."""
    rgb = np.ascontiguousarray(rgb, np.uint8)
    h, w = rgb.shape[:2]
    kind = 2 if rgb.ndim == 3 else 0

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    raw = b"".join(b"\x00" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def glyph_png(values: list[float], side: int = 8, scale: int = 12) -> bytes:
    """A small grey picture of a vector, brightest at its peak, each value a square of pixels."""
    grid = np.asarray(values, float)[: side * side].reshape(side, -1)
    return png(np.kron(np.rint(255 * grid / max(grid.max(), 1e-9)), np.ones((scale, scale))))


def orientation(data: bytes) -> int:
    """The EXIF orientation (1 to 8) of a JPEG or PNG file, 1 where it states none."""
    if data[:2] == b"\xff\xd8":
        pos = 2
        while pos + 4 <= len(data) and data[pos] == 0xFF and data[pos + 1] != 0xDA:
            size = int.from_bytes(data[pos + 2 : pos + 4], "big")
            if data[pos + 1] == 0xE1 and data[pos + 4 : pos + 10] == b"Exif\0\0":
                return _tiff_orientation(data[pos + 10 : pos + 2 + size])
            pos += 2 + max(size, 2)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        pos = 8
        while pos + 12 <= len(data):
            size = int.from_bytes(data[pos : pos + 4], "big")
            if data[pos + 4 : pos + 8] == b"eXIf":
                return _tiff_orientation(data[pos + 8 : pos + 8 + size])
            pos += 12 + size
    return 1


def _tiff_orientation(tiff: bytes) -> int:
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    at = int.from_bytes(tiff[4:8], order)
    for k in range(int.from_bytes(tiff[at : at + 2], order)):
        entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if int.from_bytes(entry[:2], order) == 0x0112:
            value = int.from_bytes(entry[8:10], order)
            return value if 1 <= value <= 8 else 1
    return 1


def upright(rgb: np.ndarray, how: int) -> np.ndarray:
    """The picture as its EXIF orientation says that it is to be seen."""
    if how >= 5:  # stored on its side
        rgb, how = rgb.transpose(1, 0, 2), {5: 1, 6: 2, 7: 3, 8: 4}[how]
    return {1: rgb, 2: rgb[:, ::-1], 3: rgb[::-1, ::-1], 4: rgb[::-1]}[how]


SUFFIXES = ("png", "jpg", "jpeg", "bmp", "gif")
PATTERN = "*.{" + ",".join([*SUFFIXES, *(s.upper() for s in SUFFIXES)]) + "}"


def plain_path(path: Column) -> Column:
    """A path without the scheme of local files, of which Spark's sources write two forms."""
    return F.regexp_replace(path, "^file:/+", "/")


#: A folder of class folders, rows (image_path, label) of listed files, or a list of such pairs.
Source = str | DataFrame | list[tuple[str, str]]
PATH_NAMES, LABEL_NAMES = ("path", "filepath", "file", "filename", "image"), ("label", "class", "target", "y")
#: Folders that the files of a list may lie in.
MOST_FOLDERS = 10_000


def image_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(image_path, label) of a folder of class folders, or of a CSV file (or a folder with one) that lists paths and labels.

    Spark lists the folders, in whatever file system they are, and reads the list as a table; a listed path is absolute or
    relative to the list's folder, and one that isn't there is an error that names it. No list of files is made in Python.
    """
    files = Files(spark)
    if not files.exists(root):
        raise FileNotFoundError(root)
    if not files.is_folder(root):
        return _listed(spark, root)
    folders = [n for n in files.names(root) if files.is_folder(f"{root}/{n}")]
    if folders:
        found = with_labels(files_of(spark, "binaryFile", root).select(plain_path(F.col("path")).alias("image_path")), root)
        if found.isEmpty():
            raise ValueError("no images in the class folders")
        return found.select("image_path", "label")
    lists = [n for n in files.names(root) if n.lower().endswith(".csv")]
    if len(lists) != 1:
        raise ValueError("a folder of class folders, or one CSV file, is needed")
    return _listed(spark, f"{root}/{lists[0]}")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.option("header", True).option("escape", '"').csv(path)
    names = {n.lower(): n for n in table.columns}
    file, label = (next((names[n] for n in known if n in names), None) for known in (PATH_NAMES, LABEL_NAMES))
    if not file or not label:
        raise ValueError("a column of paths and one of labels are needed")
    base = Files(spark).full(path).rpartition("/")[0]
    named = F.col(f"`{file}`")
    whole = F.when(named.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), named).otherwise(F.concat_ws("/", F.lit(base), named))
    rows = settled(table.where(named.isNotNull()).select(normal_path(plain_path(whole)).alias("image_path"), F.coalesce(F.col(f"`{label}`"), F.lit("nan")).alias("label")))
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    there = files_of(spark, "binaryFile", rows).select(plain_path(F.col("path")).alias("image_path"))
    missing = rows.join(there, "image_path", "left_anti").orderBy("image_path").first()
    if missing:
        raise FileNotFoundError(missing["image_path"])
    return rows


@F.pandas_udf(T.StringType())
def normal_path(paths: pd.Series) -> pd.Series:
    """Paths without . and .. and double strokes; a scheme and what it names stay."""

    def one(path: str) -> str:
        scheme, rest = re.match(r"([A-Za-z][A-Za-z0-9+.-]*://[^/]*)?(.*)", path, re.DOTALL).groups()
        return (scheme or "") + posixpath.normpath(rest or "/")

    return paths.map(one)


def folders_of(rows: DataFrame) -> list[str]:
    """The folders that the files of a list lie in: MOST_FOLDERS at most."""
    found = rows.select(F.regexp_replace("image_path", "/[^/]*$", "").alias("f")).distinct().limit(MOST_FOLDERS + 1).collect()
    if len(found) > MOST_FOLDERS:
        raise ValueError(f"the files of a list lie in more than {MOST_FOLDERS} folders")
    files = Files(rows.sparkSession)
    return [f for f in sorted(r["f"] or "/" for r in found) if files.exists(f)]


def files_of(spark: SparkSession, kind: str, source: Source) -> DataFrame:
    """Files read by a source of Spark, from a folder of class folders (those without a leading dot, by suffix), or the
    folders that a list's files lie in."""
    if isinstance(source, str):
        return spark.read.format(kind).option("pathGlobFilter", PATTERN).load(f"{source}/*/*")
    if isinstance(source, list):
        return spark.read.format(kind).load(sorted({p for p, _ in source}))
    # a glob for each folder names its files alone: those of folders within it are not looked for
    folders = folders_of(source)
    if not folders:
        raise FileNotFoundError(source.first()["image_path"])
    return spark.read.format(kind).option("pathGlobFilter", PATTERN).load([f"{f}/*" for f in folders])


def with_labels(files: DataFrame, source: Source) -> DataFrame:
    """Rows (image_path, ...) with their labels: the folder, or what the list says; a path that is listed twice comes twice."""
    if isinstance(source, str):
        parts = F.split("image_path", "/")
        shown = ~F.element_at(parts, -1).startswith(".") & ~F.element_at(parts, -2).startswith(".")
        return files.where(shown).withColumn("label", F.element_at(parts, -2))
    listed = source if isinstance(source, DataFrame) else files.sparkSession.createDataFrame(source, "image_path string, label string")
    return listed.select(plain_path(F.col("image_path")).alias("image_path"), "label").join(files, "image_path")


def read_images(spark: SparkSession, source: Source) -> DataFrame:
    """(image_path, label, content)."""
    files = files_of(spark, "binaryFile", source).select(plain_path(F.col("path")).alias("image_path"), "content")
    return with_labels(files, source).select("image_path", "label", "content")


def from_pixels(spark: SparkSession, source: Source, made: T.StructField, make: Callable[[np.ndarray], object]) -> DataFrame:
    """(image_path, label, made): what `make` makes of the pixels of each image, upright.

    Spark's image source decodes the files, and their EXIF orientation is applied. A file that cannot be decoded is an
    error that names it: no row is lost.
    """
    pixels = files_of(spark, "image", source).select("image.*").withColumn("image_path", plain_path(F.col("origin")))
    turn = files_of(spark, "binaryFile", source).select(plain_path(F.col("path")).alias("image_path"), _orientations("content").alias("turn"))
    df = with_labels(pixels.join(turn, "image_path"), source).select("image_path", "label", "height", "width", "nChannels", "data", "turn")
    schema = T.StructType([T.StructField("image_path", T.StringType()), T.StructField("label", T.StringType()), made])
    kind = pa.list_(pa.float64()) if isinstance(made.dataType, T.ArrayType) else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for r in b.to_pylist():
                if r["height"] <= 0 or r["width"] <= 0:
                    raise ValueError(f"{r['image_path']} is no image that can be decoded")
                stored = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                rgb = np.repeat(stored, 3, axis=2) if r["nChannels"] == 1 else stored[..., 2::-1]  # stored as BGR
                for column, value in zip(out, (r["image_path"], r["label"], make(upright(rgb, r["turn"])))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], kind)], names=schema.names)

    return df.mapInArrow(run, schema)


def image_features(spark: SparkSession, source: Source) -> DataFrame:
    """(image_path, label, features) of a folder of class folders or of listed images."""
    return from_pixels(spark, source, T.StructField("features", T.ArrayType(T.DoubleType())), lambda rgb: classic_features(rgb).tolist())


def thumbnails(spark: SparkSession, source: Source, side: int = 96) -> DataFrame:
    """(image_path, label, png): a PNG file of each image, upright, side x side pixels."""
    return from_pixels(spark, source, T.StructField("png", T.BinaryType()), lambda rgb: png(np.rint(resize(rgb, side, side)).clip(0, 255)))


@F.pandas_udf(T.IntegerType())
def _orientations(contents: pd.Series) -> pd.Series:
    return contents.map(orientation)


def materialize_shapes(folder: str, n_per_class: int = 24, seed: int = 42) -> str:
    """Write pictures of discs on plain ground, and of checkered tiles, in a folder for each class."""
    import os

    rng = np.random.default_rng(seed)
    y, x = np.indices((96, 96))
    for label in ("disc", "tile"):
        os.makedirs(f"{folder}/{label}", exist_ok=True)
        for i in range(n_per_class):
            ground, ink = rng.integers(0, 90, 3), rng.integers(150, 255, 3)
            cx, cy, r = rng.integers(30, 66, 2).tolist() + [int(rng.integers(14, 28))]
            mask = (x - cx) ** 2 + (y - cy) ** 2 < r * r if label == "disc" else ((x + cx) // r + (y + cy) // r) % 2 == 0
            picture = np.where(mask[..., None], ink, ground) + rng.normal(0, 6, (96, 96, 1))
            with open(f"{folder}/{label}/{label}-{i:03d}.png", "wb") as f:
                f.write(png(picture.clip(0, 255)))
    return folder
