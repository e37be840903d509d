"""Tables on a shared file system that change by copy-on-write.

data/<run>/     parquet files, never changed once written, each a range of the key order: many small
                repositories share a file, a large one spans several
log/<version>/  the live files of one version, one row each; the last complete one counts

A change is told by keys. Files that hold one of these keys are found by a scan of the key columns
alone; only they are read whole and written anew, without the old rows and with the new ones. All
others go into the next version as they are. The driver handles names of files, as it does for any
scan, never keys. A run that dies before its version is written has changed nothing."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import cut


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, ddl: str, keys: tuple[str, ...] = ("repo", "path")):
        self.spark, self.root, self.ddl, self.keys = spark, root.rstrip("/"), ddl, list(keys)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        out = []
        for name in self._names("log"):
            fs, done = self._fs(f"{self.root}/log/{name}/_SUCCESS")
            if name.isdigit() and fs.exists(done):
                out.append(int(name))
        return sorted(out)

    def files(self, version: int | None = None) -> list[str]:
        """Live files of a version (the last one), relative to data/."""
        versions = self.versions()
        version = versions[-1] if version is None and versions else version
        if version is None:
            return []
        log = self.spark.read.schema("file string").parquet(f"{self.root}/log/{version:012d}")
        return [r.file for r in log.collect()]

    def _frame(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(*(f"{self.root}/data/{f}" for f in files))

    def read(self, version: int | None = None) -> DataFrame:
        return self._frame(self.files(version))

    def files_with(self, keys: DataFrame, on: list[str] | None = None) -> list[str]:
        """Live files that hold a row with one of `keys`; only the key columns are scanned."""
        on, files = on or self.keys, self.files()
        if not files:
            return []
        held = self._frame(files).select(*on, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_file"),
                                         F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("_run"))
        found = held.join(keys.select(*on).distinct(), on, "left_semi").select("_run", "_file").distinct().collect()
        return sorted(f"{r._run}/{r._file}" for r in found)

    def matching(self, keys: DataFrame, files: list[str], on: list[str] | None = None) -> DataFrame:
        """Rows with one of `keys`, read from `files` (as `files_with` gives them) alone."""
        on = on or self.keys
        return self._frame(files).join(keys.select(*on).distinct(), on, "left_semi").select(*self._columns())

    def _columns(self) -> list[str]:
        return StructType.fromDDL(self.ddl).fieldNames()

    def change(self, gone: DataFrame, rows: DataFrame | None = None, files: list[str] | None = None,
               on: list[str] | None = None) -> None:
        """Next version: without the rows that have a key in `gone`, with `rows`.

        `files` may pass on what `files_with(gone, on)` gave. Null keys are equal to nothing."""
        on, live = on or self.keys, self.files()
        touched = self.files_with(gone, on) if files is None else files
        after = self._frame(touched).join(gone.select(*on).distinct(), on, "left_anti").select(*self._columns())
        if rows is not None:
            after = after.unionByName(rows.select(*self._columns()))
        self._commit([f for f in live if f not in set(touched)] + self._write(after))

    def replace(self, rows: DataFrame, on: list[str] | None = None) -> DataFrame:
        """Next version: with `rows`, and without the old rows that share one of their keys `on`. Returns `rows` as
        written: their keys are read back from there, so nothing is kept besides the table's own files."""
        on, live = on or self.keys, self.files()
        new = self._write(rows.select(*self._columns()))
        written = self._frame(new)
        keys = written.select(*on).distinct()
        touched = self.files_with(keys, on)
        left = self._write(self._frame(touched).join(keys, on, "left_anti").select(*self._columns())) if touched else []
        self._commit([f for f in live if f not in set(touched)] + left + new)
        return written

    def _write(self, rows: DataFrame) -> list[str]:
        """New files in key order; adaptive execution sets their number by size."""
        run = uuid.uuid4().hex
        rows.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.root}/data/{run}")
        return [f"{run}/{name}" for name in self._names(f"data/{run}") if name.endswith(".parquet")]

    def _commit(self, files: list[str]) -> None:
        version = (self.versions() or [-1])[-1] + 1
        rows = self.spark.createDataFrame([(f,) for f in files], "file string").coalesce(1)
        rows.write.parquet(f"{self.root}/log/{version:012d}")       # raises if another writer was first

    def compact(self, small_bytes: int = 32 << 20) -> None:
        """Files below `small_bytes` are put together into new ones."""
        small = []
        for name in self.files():
            fs, p = self._fs(f"{self.root}/data/{name}")
            if fs.getFileStatus(p).getLen() < small_bytes:
                small.append(name)
        if len(small) > 1:
            live = self.files()
            self._commit([f for f in live if f not in set(small)] + self._write(self._frame(small)))

    def vacuum(self, keep: int = 2) -> None:
        """Delete the log of all but the last `keep` versions, and files that only those had."""
        versions = self.versions()
        kept = {f for v in versions[-keep:] for f in self.files(v)}
        old = {f for v in versions[:-keep] for f in self.files(v)}
        for path in [f"data/{f}" for f in sorted(old - kept)] + [f"log/{v:012d}" for v in versions[:-keep]]:
            fs, p = self._fs(f"{self.root}/{path}")
            fs.delete(p, True)

    def drop(self) -> None:
        fs, p = self._fs(self.root)
        if fs.exists(p):
            fs.delete(p, True)
