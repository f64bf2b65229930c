"""Versioned tables: the tables of a write go to new folders, then a manifest of the new version appears under its final name.

A manifest names the folder of every table, so tables that a write does not touch are not copied. Manifests are written
aside and renamed without overwriting: readers see the old version until then, a crash at any point leaves the old
version whole, and of two writers of one version the second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleVersion(RuntimeError):
    """Another write came first."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)

    def version(self) -> int:
        """Current version, 0 before the first write."""
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return 0
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folder of each table of a version, the current one by default."""
        v = self.version() if version is None else version
        if not v:
            return {}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/versions/v{v:012d}.json", wholetext=True).collect()))

    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.manifest(version)[table]}")

    def commit(self, tables: dict[str, DataFrame], expected: int | None = None) -> int:
        """Write a new version: given tables anew, the others stay where they are. Returns its number.

        ``expected`` is the version the write was planned on, the current one by default.
        """
        old = self.version() if expected is None else expected
        named, mark = self.manifest(old), uuid.uuid4().hex
        for name, frame in tables.items():
            named[name] = f"data/{mark}/{name}"
            frame.write.mode("overwrite").parquet(f"{self.root}/{named[name]}")
        self._publish(old + 1, named, mark)
        return old + 1

    def _publish(self, version: int, named: dict[str, str], mark: str) -> None:
        aside, final = self._path(f"{self.root}/versions/.{mark}"), self._path(f"{self.root}/versions/v{version:012d}.json")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(named, sort_keys=True).encode()))
        out.close()
        never = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = never
        try:
            if self.version() >= version:
                raise StaleVersion("E_SYNC_STAGE_STALE: another write came first")
            self._context.rename(aside, final, options)
        except StaleVersion:
            raise
        except Exception as e:
            if self._fs.exists(final):
                raise StaleVersion("E_SYNC_STAGE_STALE: another write came first") from e
            raise
        finally:
            if self._fs.exists(aside):
                self._fs.delete(aside, False)


class ChangelogStore:
    """An append-only change log in Parquet, partitioned by origin."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, changes: DataFrame) -> None:
        """Add changes (with ``payload``); their checksum and size are computed here."""
        full = changes.withColumns({"payload_checksum": F.sha2("payload", 256), "byte_size": F.octet_length("payload").cast("long")})
        full.write.mode("append").partitionBy("origin").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def truncate(self, below: dict[str, int]) -> int:
        """Drop what every peer has acknowledged: per origin the entries up to a sequence. Returns how many went.

        Only the partitions of these origins are rewritten: aside first, then swapped by rename.
        """
        gone = 0
        for origin, upto in sorted(below.items()):
            mine = self.read().filter(F.col("origin") == origin)
            gone += mine.filter(F.col("seq") <= upto).count()
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path
            fs = path(self.path).getFileSystem(conf)
            folder = f"{self.path}/origin={origin}"
            aside, old = f"{self.path}/_kept-{uuid.uuid4().hex}", f"{self.path}/_old-{uuid.uuid4().hex}"
            mine.filter(F.col("seq") > upto).drop("origin").write.parquet(aside)
            fs.rename(path(folder), path(old))
            fs.rename(path(aside), path(folder))
            fs.delete(path(old), True)
        return gone

    def corrupt(self) -> DataFrame:
        """Entries whose payload no longer has its checksum."""
        return self.read().filter(~F.sha2("payload", 256).eqNullSafe(F.col("payload_checksum")))
