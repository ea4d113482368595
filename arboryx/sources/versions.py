"""Tables as folders of whole versions: a new one is written aside and then becomes the latest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """``path/v=<n>`` holds version n; a version counts once its _SUCCESS file is there.

    Readers never see half a version, a failed writer leaves nothing that counts, and a batch that is
    run again writes the same version again, so ticks are idempotent. One writer at a time: numbers come from a listing. All file access goes through
    Hadoop's file system, so the path may be anywhere that Spark can read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._hadoop.Path(self.path)):
            return []
        names = [s.getPath() for s in self._fs.listStatus(self._hadoop.Path(self.path))]
        done = [p.getName() for p in names if self._fs.exists(self._hadoop.Path(p, "_SUCCESS"))]
        return sorted(int(n[2:]) for n in done if n.startswith("v="))

    def read(self, version: int | None = None) -> DataFrame:
        some = self.versions()
        if version is None and not some:
            raise FileNotFoundError(f"no version in {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={some[-1] if version is None else version}")

    def commit(self, df: DataFrame, version: int | None = None) -> int:
        some = self.versions()
        number = (some[-1] + 1 if some else 0) if version is None else version
        df.write.mode("overwrite").parquet(f"{self.path}/v={number}")
        return number

    def prune(self, keep: int = 2) -> list[int]:
        """Deletes all but the latest ``keep`` versions; returns the deleted ones."""
        old = self.versions()[:-keep] if keep else self.versions()
        for n in old:
            self._fs.delete(self._hadoop.Path(f"{self.path}/v={n}"), True)
        return old


class VersionSet:
    """Several tables that are committed together: ``path/v=<n>/<table>``, of which all count or none.

    A version counts once its ``_COMMITTED`` file is there, which is made last. Its number is claimed by making a
    file that must not exist yet, so two writers never share one; a writer that fails leaves a number that
    never counts, and readers stay with the version before.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def _numbers(self, folder: str) -> list[int]:
        if not self._fs.exists(self._at(folder) if folder else self._at()):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(folder) if folder else self._at())]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def versions(self) -> list[int]:
        return [n for n in self._numbers("") if self._fs.exists(self._at(f"v={n}", "_COMMITTED"))]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        some = self.versions()
        if not some:
            raise FileNotFoundError(f"no version in {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={some[-1] if version is None else version}/{table}")

    def commit(self, tables: Mapping[str, DataFrame]) -> int:
        """Writes all ``tables`` as the next version, and returns its number."""
        number = max([-1, *self._numbers("_claims"), *self.versions()]) + 1
        while not self._fs.createNewFile(self._at("_claims", f"v={number}")):
            number += 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/v={number}/{name}")
        self._fs.createNewFile(self._at(f"v={number}", "_COMMITTED"))
        return number

    def prune(self, keep: int = 2) -> list[int]:
        """Deletes all but the latest ``keep`` versions, and what failed before them; returns the deleted ones."""
        stay = self.versions()[-keep:] if keep else []
        old = [n for n in self._numbers("") if n not in stay and (not stay or n < stay[-1])]
        for n in old:
            self._fs.delete(self._at(f"v={n}"), True)
        return old
