"""Tables that are merged in place, a hash bucket of the key at a time.

Rows lie in buckets by a hash of their key.  A merge reads and writes the
buckets that its changes touch, no others.  A commit is a small file that names
the folder of each bucket, and for each source of batches the last one that was
applied: a batch that is run again changes nothing, and a source that starts
anew (a stream with a new checkpoint) has a ledger entry of its own, so that
its first batch counts.  One writer at a time; readers see the last commit, and
those that began before it keep their files for a few commits more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The lasting id of the streaming query with this checkpoint folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    return json.loads(_text(jvm, path.getFileSystem(conf), path))["id"]


def _text(jvm, fs, path) -> str:
    stream = fs.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class MergeTable:
    """``buckets`` counts for a new table only; a table keeps the number that
    it was made with.  Choose it so that a bucket is some hundred megabytes."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16, keep: int = 5):
        self.spark, self.path, self.schema, self.keys, self.keep = spark, path.rstrip("/"), schema, keys, keep
        self._new = {"version": -1, "n": buckets, "buckets": {}, "ledger": {}, "last": None}
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ commits

    def versions(self) -> list[int]:
        """Numbers of the commits that are kept."""
        names = self._names("commits")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _names(self, folder: str) -> list[str]:
        root = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def manifest(self, version: int | None = None) -> dict:
        """The last commit, or a kept one."""
        if version is None:
            kept = self.versions()
            if not kept:
                return self._new
            version = kept[-1]
        return json.loads(_text(self._jvm, self._fs, self._path(f"{self.path}/commits/{version}.json")))

    def _commit(self, manifest: dict) -> None:
        """Written aside and renamed, so that no reader sees a part of it."""
        aside, to = self._path(f"{self.path}/aside/{uuid.uuid4().hex}"), self._path(f"{self.path}/commits/{manifest['version']}.json")
        self._fs.mkdirs(to.getParent())
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(aside, to):
            raise RuntimeError(f"another writer made version {manifest['version']} of {self.path}")

    # ------------------------------------------------------------ rows

    def bucket(self, manifest: dict):
        return F.pmod(F.xxhash64(*self.keys), F.lit(manifest["n"])).cast("int")

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        names = sorted(manifest["buckets"], key=int) if buckets is None else [str(b) for b in buckets if str(b) in manifest["buckets"]]
        paths = [f"{self.path}/data/{manifest['buckets'][n]}/{BUCKET}={n}" for n in names]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets of the changes' keys: at most as many as there are."""
        return sorted(r[0] for r in changes.select(self.bucket(self.manifest())).distinct().collect())

    def read_for(self, changes: DataFrame) -> DataFrame:
        """The rows of the buckets that the changes' keys are in."""
        return self._rows(self.manifest(), self.touched(changes))

    def done(self, source: str, batch: int) -> bool:
        return self.manifest()["ledger"].get(source, -1) >= batch

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], source: str, batch: int) -> int | None:
        """``apply(rows, changes)`` in place of the rows of the buckets that the
        changes (with the table's keys) touch; what it gives must stay in them.
        The version, or none if the source's batch was applied before."""
        now = self.manifest()
        if now["ledger"].get(source, -1) >= batch:
            return None
        # They are read for their buckets and for the merge.
        ours = not (changes.storageLevel.useMemory or changes.storageLevel.useDisk)
        if ours:
            changes = changes.persist()
        buckets = self.touched(changes)
        held = {k: v for k, v in now["buckets"].items() if int(k) not in set(buckets)}
        if buckets:
            folder = uuid.uuid4().hex
            rows = apply(self._rows(now, buckets), changes).select(*self.spark.createDataFrame([], self.schema).columns)
            rows.withColumn(BUCKET, self.bucket(now)).repartition(len(buckets), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
            found = [n.partition("=")[2] for n in self._names(f"data/{folder}") if n.startswith(f"{BUCKET}=")]
            if not set(map(int, found)) <= set(buckets):
                raise ValueError(f"a merge of {self.path} wrote rows to buckets that its changes don't touch")
            held |= dict.fromkeys(found, folder)
        if ours:
            changes.unpersist()
        version = now["version"] + 1
        self._commit({**now, "version": version, "buckets": held, "ledger": {**now["ledger"], source: batch}, "last": source})
        self.clean_up()
        return version

    def clean_up(self) -> int:
        """Drop all but the last ``keep`` commits and the folders that only they,
        or writers that failed, used; how many folders."""
        versions = self.versions()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        used: dict[str, set[str]] = {}
        for v in kept:
            for n, folder in self.manifest(v)["buckets"].items():
                used.setdefault(folder, set()).add(f"{BUCKET}={n}")
        gone = 0
        for folder in self._names("data"):
            if folder not in used:
                self._fs.delete(self._path(f"{self.path}/data/{folder}"), True)
                gone += 1
            else:
                for name in self._names(f"data/{folder}"):
                    if name.startswith(f"{BUCKET}=") and name not in used[folder]:
                        self._fs.delete(self._path(f"{self.path}/data/{folder}/{name}"), True)
                        gone += 1
        for v in old:
            self._fs.delete(self._path(f"{self.path}/commits/{v}.json"), False)
        return gone
