"""Files and folders of whatever file system a path names, through Hadoop's interface."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """The few operations that plans need; paths may have any scheme, or none for the default file system."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_folder(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def full(self, path: str) -> str:
        """The path with its scheme, written one way."""
        fs, p = self._at(path)
        return fs.makeQualified(p).toString().rstrip("/")

    def names(self, folder: str) -> list[str]:
        """What lies in a folder, but for names that begin with a dot or an underscore."""
        fs, p = self._at(folder)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in found if not n.startswith((".", "_")))

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        """Move to a name that is free; a name that isn't is an error."""
        fs, p = self._at(old)
        target = self.jvm.org.apache.hadoop.fs.Path(new)
        if fs.exists(target) or not fs.rename(p, target):
            raise FileExistsError(new)

    def put(self, local: str, path: str) -> None:
        """Copy a local file or folder to a path of any file system."""
        fs, p = self._at(path)
        fs.copyFromLocalFile(self.jvm.org.apache.hadoop.fs.Path(f"file://{local}"), p)

    def write_text(self, path: str, text: str) -> None:
        """Write beside the target, then rename: readers see the whole file or none, or the old one."""
        fs, p = self._at(path)
        staged = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(text.encode())
        out.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(staged, p)

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def part_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(part, bytes, sha256) of all files below a folder that writers have left there, by their paths within it."""
    root = Files(spark).full(folder).replace(":///", ":/")
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+(?=[^/])", "$1:/")
    # local files as they are: their checksum files would make a changed one unreadable
    bare = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "recursiveFileLookup": "true"}
    found = spark.read.format("binaryFile").options(**bare).load(folder)
    within = F.expr("substring(p, length(r) + 2)")
    named = found.withColumns({"p": plain(F.col("path")), "r": plain(F.lit(root))}).withColumn("part", within)
    return named.select("part", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
