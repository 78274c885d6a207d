"""Versioned tables: staged writes that become visible at once.

A version is a folder; it counts when Spark's success mark is in it.  Readers
take the last one.  Branches are versions beside each other of which one is
committed.  All file operations go through Hadoop's file system, so the folder
can be in any store that Spark reaches.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        last = self.versions()
        if not last:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{last[-1]}")

    def write(self, rows: DataFrame, version: int) -> None:
        """Idempotent: a version that is there already stays as it is."""
        if version not in self.versions():
            rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def write_batch(self, rows: DataFrame, source: str, batch: int) -> int | None:
        """``rows`` as the next version, or nothing if a version is there that
        the source's batch made: whatever other versions there are, it isn't
        lost.  The version's folder carries the batch as a mark."""
        marks = [s.getPath().getName() for v in self.versions() for s in self._fs.listStatus(self._path(f"{self.path}/v{v}"))]
        mark = f"_batch-{source}-{batch}"
        if mark in marks:
            return None
        name = self.stage(rows)
        self._fs.create(self._path(f"{name}/{mark}"), True).close()
        return self.commit(name)

    def keep(self, last: int) -> int:
        """Drop all but the last versions; how many."""
        old = self.versions()[:-last]
        for v in old:
            self._fs.delete(self._path(f"{self.path}/v{v}"), True)
        return len(old)

    def stage(self, rows: DataFrame) -> str:
        """Write rows aside; readers don't see them."""
        name = f"{self.path}/_staging/{uuid.uuid4().hex}"
        rows.write.parquet(name)
        return name

    def staged(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(name)

    def commit(self, name: str) -> int:
        """Make a staged version the last one, by one rename."""
        version = (self.versions() or [-1])[-1] + 1
        if not self._fs.rename(self._path(name), self._path(f"{self.path}/v{version}")):
            raise RuntimeError(f"cannot commit {name}")
        return version

    def rollback(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def commit_winner(self, winner: int, names: list[str]) -> int:
        """Commit one branch, from 1, and drop the others."""
        if not 1 <= winner <= len(names):
            raise IndexError(f"no branch {winner}")
        version = self.commit(names[winner - 1])
        for k, name in enumerate(names, 1):
            if k != winner:
                self.rollback(name)
        return version

    def fork(self, count: int, change) -> list[str]:
        """Branches 1 to ``count``: ``change(rows, k)`` of the table's rows."""
        return [self.stage(change(self.read(), k)) for k in range(1, count + 1)]

    def copied_into(self, name: str, key: str, value: str) -> str:
        """A branch with the table's rows of one key put beside the branch's
        own, if the branch has none with it; the branch's place."""
        own = self.staged(name)
        rows = self.read().filter(F.col(key) == value)
        if rows.isEmpty() or not own.filter(F.col(key) == value).isEmpty():
            return name
        merged = self.stage(own.unionByName(rows))
        self.rollback(name)
        return merged

    def verified(self, name: str, check: str) -> dict:
        """How many rows of a branch fail a condition (null fails too), and
        whether that is none.  An unknown branch is an error."""
        if not re.fullmatch(r"[0-9a-f]{32}", name.rpartition("/")[2]):
            raise ValueError(f"no branch id: {name}")
        if not self._fs.exists(self._path(name)):
            raise FileNotFoundError(f"no branch {name}")
        failed = self.staged(name).filter(~F.coalesce(F.expr(check), F.lit(False))).count()
        return {"success": failed == 0, "failed_rows": failed}

    def run(self, rows: DataFrame, check: str, commit_on_success: bool = True) -> dict:
        """Stage rows, verify them, and commit or roll back."""
        name = self.stage(rows)
        found = self.verified(name, check)
        if found["success"] and commit_on_success:
            self.commit(name)
            return {**found, "rolled_back": False}
        self.rollback(name)
        return {**found, "rolled_back": True}

    def purge(self) -> int:
        """Drop all branches that were left behind; how many."""
        root = self._path(f"{self.path}/_staging")
        if not self._fs.exists(root):
            return 0
        left = [s.getPath() for s in self._fs.listStatus(root)]
        for p in left:
            self._fs.delete(p, True)
        return len(left)
