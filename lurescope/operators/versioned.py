"""Tables with versions: snapshots (S08, T08) and a log in hash buckets.

A version is a small numbered manifest, a JSON file that names the folders of
Parquet files which make the table up.  Data folders are written first and never
changed; a version exists from the moment its manifest is renamed to the next free
number.  So a reader opened before a refresh keeps its files, a job that dies leaves
the old version, and a builder may read the version that it replaces.  Folders of
old versions go only by ``vacuum``.

Renaming to a taken name fails on a distributed file system, so of two writers one
starts over from the other's version.  A local folder (tests) has one writer.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

BUCKETS = 64


class Taken(RuntimeError):
    """Another writer made the next version."""


def utc_micros(at: datetime | None = None) -> int:
    at = at or datetime.now(timezone.utc)
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)  # a naive instant is UTC
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


class Manifests:
    """The numbered manifests below ``path``, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = f"{self.path}/manifests"

    def at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    @property
    def fs(self):
        return self.at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.at(folder)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(folder))]

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names(self.folder) if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int | None = None) -> tuple[int, dict] | None:
        """(number, content) of a version, by default the newest; None if there is none."""
        known = self.numbers() if number is None else [number]
        if not known:
            return None
        stream = self.fs.open(self.at(f"{self.folder}/{known[-1]:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return known[-1], json.loads(text)

    def commit(self, content: dict, after: int | None) -> int:
        """Publish the version that follows ``after`` (None: the first)."""
        number = 0 if after is None else after + 1
        target, draft = self.at(f"{self.folder}/{number:012d}.json"), self.at(f"{self.folder}/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            self.fs.delete(draft, False)
            raise Taken(f"version {number} of {self.path} exists")
        return number

    def change(self, edit) -> int:
        """Commit ``edit(newest content or None)``, anew whenever another writer was faster."""
        while True:
            newest = self.read()
            try:
                return self.commit(edit(newest and newest[1]), newest and newest[0])
            except Taken:
                continue

    def vacuum(self, keep: int, folders, min_age: timedelta) -> list[str]:
        """Delete all but the newest ``keep`` manifests and every data folder that none of
        those names and that is older than ``min_age`` (one that is being written is young)."""
        numbers = self.numbers()
        for number in numbers[:-keep]:
            self.fs.delete(self.at(f"{self.folder}/{number:012d}.json"), False)
        used = {f for n in numbers[-keep:] for f in folders(self.read(n)[1])}
        dead = []
        for name in self.names(f"{self.path}/data"):
            path = self.at(f"{self.path}/data/{name}")
            age = utc_micros() // 1000 - self.fs.getFileStatus(path).getModificationTime()
            if name not in used and age >= min_age / timedelta(milliseconds=1):
                self.fs.delete(path, True)
                dead.append(name)
        return sorted(dead)


class SnapshotTable:
    """A table that is replaced as a whole; each refresh is a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, path)

    def publish(self, df: DataFrame, loaded_at: datetime | None = None) -> int:
        """Write ``df`` as a new version.  It may read this very table."""
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{folder}")
        new = {"folder": folder, "schema": df.schema.json(), "loaded_at": utc_micros(loaded_at)}
        return self.manifests.change(lambda _old: new)

    def read(self, version: int | None = None) -> DataFrame | None:
        """A scan of one version, by default the newest at this moment."""
        found = self.manifests.read(version)
        if found is None:
            return None
        schema = StructType.fromJson(json.loads(found[1]["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/data/{found[1]['folder']}")

    def versions(self) -> list[int]:
        return self.manifests.numbers()

    def loaded_at(self) -> int | None:
        """Microseconds (UTC) at which the newest version was loaded."""
        found = self.manifests.read()
        return found and found[1]["loaded_at"]

    def vacuum(self, keep: int = 2, min_age: timedelta = timedelta(days=1)) -> list[str]:
        return self.manifests.vacuum(keep, lambda m: [m["folder"]], min_age)


class HashLog:
    """An append-only log whose parts are split into ``buckets`` folders by the hash of
    the key, sorted by it, with a Bloom filter on it in each file.

    A lookup of one key reads one bucket; a lookup of a batch's keys reads the buckets
    they fall into.  ``compact`` folds the parts into one snapshot of the latest
    version per key.  An append under a given part name can be repeated: the part is
    listed once and holds what the last try wrote.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "email_hash",
                 order: tuple = ("processed_at", "event_id"), buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, tuple(order)
        self.manifests = Manifests(spark, path)
        found = self.manifests.read()
        self.buckets = found[1]["buckets"] if found else buckets  # fixed by the first part

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, part: str) -> None:
        # rebalance: the rows of a bucket come together, and a large bucket is split
        (df.withColumn("bucket", self.bucket_of(F.col(self.key))).hint("rebalance", "bucket")
         .sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket")
         .option(f"parquet.bloom.filter.enabled#{self.key}", "true")
         .parquet(f"{self.path}/data/part={part}"))

    def append(self, rows: DataFrame, part: str | None = None, run: str = "", at: int | None = None) -> int:
        """Add rows as new versions of their keys.  ``run`` and ``at`` (microseconds)
        say which writer added them and when."""
        part = part or uuid.uuid4().hex
        self._write(rows, part)
        entry = {"part": part, "run": run, "at": utc_micros() if at is None else at}

        def edit(old):
            old = old or {"buckets": self.buckets, "schema": rows.schema.json(), "snapshot": None, "parts": []}
            return old | {"parts": [p for p in old["parts"] if p["part"] != part] + [entry]}
        return self.manifests.change(edit)

    def _scan(self, content: dict | None, parts: list[str]) -> DataFrame | None:
        if not content or not parts:
            return None
        schema = StructType.fromJson(json.loads(content["schema"])).add("part", StringType()).add("bucket", IntegerType())
        return (self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
                .parquet(*[f"{self.path}/data/part={p}" for p in parts]))

    def _all(self, content: dict) -> list[str]:
        return [s for s in [content["snapshot"]] if s] + [p["part"] for p in content["parts"]]

    def scan(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version with ``part`` and ``bucket``; None if there is none."""
        found = self.manifests.read(version)
        return found and self._scan(found[1], self._all(found[1]))

    def part(self, name: str) -> DataFrame:
        """The rows of one part."""
        return self._scan(self.manifests.read()[1], [name]).drop("part", "bucket")

    def versions(self, version: int | None = None) -> DataFrame | None:
        rows = self.scan(version)
        return None if rows is None else rows.drop("part", "bucket")

    def latest(self, version: int | None = None) -> DataFrame | None:
        """The latest row per key."""
        from lurescope.operators.detections import latest_versions
        rows = self.versions(version)
        return None if rows is None else latest_versions(rows, self.key, self.order)

    def lookup(self, key: str) -> DataFrame | None:
        """The latest row of one key, from its bucket alone."""
        from lurescope.operators.detections import latest_versions
        rows = self.scan()
        if rows is None:
            return None
        rows = rows.filter((F.col("bucket") == self.bucket_of(F.lit(key))) & (F.col(self.key) == F.lit(key)))
        return latest_versions(rows.drop("part", "bucket"), self.key, self.order)

    def unseen(self, batch: DataFrame, run: str | None = None, since: int | None = None,
               but: str | None = None) -> DataFrame:
        """The rows of ``batch`` whose key the log does not hold.  Parts that ``run``
        added at ``since`` or later are left out (a state store knows their keys), and so
        is the part ``but``.  Only the batch's buckets are read; their numbers, at most
        ``buckets``, go through the driver."""
        found = self.manifests.read()
        if found is None:
            return batch
        known = [p["part"] for p in found[1]["parts"] if p["part"] != but
                 and (run is None or p["run"] != run or since is None or p["at"] < since)]
        rows = self._scan(found[1], [s for s in [found[1]["snapshot"]] if s] + known)
        if rows is None:
            return batch
        touched = [r[0] for r in batch.select(self.bucket_of(F.col(self.key))).distinct().collect()]
        seen = rows.filter(F.col("bucket").isin(touched)).select(self.key)
        return batch.join(seen, self.key, "left_anti").select(*batch.columns)

    def compact(self) -> int | None:
        """Fold all parts into a snapshot of the latest version per key.  Parts that are
        appended meanwhile stay parts; a compaction that dies changes nothing."""
        found = self.manifests.read()
        if found is None or not found[1]["parts"]:
            return found and found[0]
        number, content = found
        folded = {p["part"] for p in content["parts"]}
        snapshot = f"snapshot-{uuid.uuid4().hex}"
        self._write(self.latest(number), snapshot)

        def edit(now):
            if now["snapshot"] != content["snapshot"]:
                raise RuntimeError("another compaction was faster; its snapshot stays")
            return now | {"snapshot": snapshot, "parts": [p for p in now["parts"] if p["part"] not in folded]}
        return self.manifests.change(edit)

    def vacuum(self, keep: int = 2, min_age: timedelta = timedelta(days=1)) -> list[str]:
        return self.manifests.vacuum(keep, lambda m: [f"part={p}" for p in self._all(m)], min_age)
