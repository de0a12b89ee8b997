"""A persisted key-value table: runs as Parquet, listed by versioned manifests.

A write becomes visible by its manifest alone: version n + 1 is a new file next to version n, created only if it is not there
and only after the run's own commit has succeeded. Readers pin a version; its files are immutable and stay until vacuum().

Runs keep each entry's sequence number, and reads fold by it, not by the order in which runs arrived: batches may come late, out
of order or twice. The manifest keeps the last batch of each source, so a batch that is replayed is not written again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.model import MUTATION, PUT, TABLE_RUN, checked, not_deleted
from foldmark.operators import runs, state


class KVTable:
    """put / delete / get over a folder in any store that Spark writes to. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def open(cls, spark: SparkSession, path: str, log_path: str) -> KVTable:
        """The table with all valid records of the log files under log_path applied. A log that was applied before changes nothing,
        since its records keep their sequence numbers."""
        from foldmark.sources.wal import WriteAheadLog

        table, log = cls(spark, path), WriteAheadLog(spark, log_path).read()
        if not log.isEmpty():
            table.apply(log)
        return table

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at("manifest")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _read(self, version: int) -> dict | None:
        """The manifest, or None if its writer died before it was whole."""
        stream = self._fs.open(self._at("manifest", f"v{version}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return [v for v in self._numbers() if self._read(v)]

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "next_seq", "floor", "batches", "runs": [{"path", "file_seq", "level", "rows"}, ...]}, oldest run first."""
        for v in reversed(self._numbers()) if version is None else [version]:
            if found := self._read(v):
                return found
        if version is not None:
            raise ValueError(f"there is no version {version}")
        return {"version": 0, "next_seq": 1, "floor": None, "batches": {}, "runs": []}

    def _commit(self, old: dict, **changes) -> int:
        new = old | changes | {"version": max([old["version"], *self._numbers()]) + 1}
        stream = self._fs.create(self._at("manifest", f"v{new['version']}.json"), False)  # fails if another writer was quicker
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        return new["version"]

    def _write(self, run: DataFrame, at_most: int) -> dict:
        """Write a run of at most so many rows, which is what its Bloom filters are sized for; the run is computed once."""
        name = f"run-{uuid.uuid4().hex}"
        runs.write_run(run.select(*self.spark.createDataFrame([], TABLE_RUN).columns), f"{self.path}/{name}", at_most)
        written = self.spark.read.schema(TABLE_RUN).parquet(f"{self.path}/{name}")
        rows, top, least = written.agg(F.count(F.lit(1)), F.max("seq"), F.min("seq")).first()
        return {"path": name, "rows": rows, "max_seq": top, "min_seq": least}

    def apply(self, log: DataFrame, batch: int | None = None, source: str = "") -> int:
        """Fold mutations (seq, op, key, val) into a new run and commit it; the new version. A batch number that is not over the
        last one committed for its source changes nothing. After a compaction that dropped deletes, mutations no newer than
        those fail, as what they overwrote would come back."""
        old = self.manifest()
        if batch is not None and batch <= old["batches"].get(source, -1):
            return old["version"]
        top = max((r["file_seq"] for r in old["runs"]), default=0) + 1
        newest = state.fold(checked(log)).select(F.lit(top).cast("long").alias("file_seq"), F.lit(PUT).cast("byte").alias("op"), "key", "val", "seq")
        entry = self._write(newest, log.count()) | {"file_seq": top, "level": 0}
        if old["floor"] is not None and entry["rows"] and entry["min_seq"] <= old["floor"]:
            self._fs.delete(self._at(entry["path"]), True)
            raise ValueError(f"mutations up to {old['floor']} are closed: a compaction has dropped deletes")
        batches = old["batches"] | ({source: batch} if batch is not None else {})
        return self._commit(old, runs=[*old["runs"], entry], next_seq=max(old["next_seq"], (entry["max_seq"] or 0) + 1), batches=batches)

    def _one(self, key: bytes, val: bytes) -> int:
        seq = self.manifest()["next_seq"]
        return self.apply(self.spark.createDataFrame([(seq, PUT, bytearray(key), bytearray(val))], MUTATION))

    def put(self, key: bytes, val: bytes) -> int:
        """One mutation, newer than all there are, is one run: batch mutations with apply() wherever there are more. An empty val
        deletes."""
        return self._one(key, val)

    def delete(self, key: bytes) -> int:
        return self._one(key, b"")

    def runs(self, version: int | None = None, names: list[str] | None = None) -> DataFrame:
        """The entries of all runs, or of those named, by one scan however many there are."""
        paths = [f"{self.path}/{r['path']}" for r in self.manifest(version)["runs"] if names is None or r["path"] in names]
        return self.spark.read.schema(TABLE_RUN).parquet(*paths) if paths else self.spark.createDataFrame([], TABLE_RUN)

    def _newest(self, entries: DataFrame) -> DataFrame:
        """Each key's newest entry: by sequence number, equal ones by run."""
        order = F.struct("seq", "file_seq")
        newest = entries.groupBy("key").agg(F.max_by(F.struct("op", "val"), order).alias("e"), F.max(order).alias("o"))
        return newest.select("o.file_seq", "e.op", "key", "e.val", "o.seq")

    def live(self, version: int | None = None) -> DataFrame:
        """key, val and seq of all live keys."""
        return self._newest(self.runs(version)).filter(not_deleted()).select("key", "val", "seq")

    def get(self, key: bytes, version: int | None = None) -> bytes | None:
        """The filter on the key reaches the scan, where min, max and Bloom filters skip what can't hold it."""
        row = self._newest(self.runs(version).filter(F.col("key") == F.lit(bytes(key)))).filter(not_deleted()).first()
        return None if row is None else bytes(row["val"])

    def multi_get(self, probes: DataFrame, version: int | None = None) -> DataFrame:
        """probes with val (null if absent) and found; probes' own columns val, seq and found are replaced."""
        probes = probes.drop("val", "found", "seq")
        own = self.runs(version).join(probes.select("key").distinct(), "key", "left_semi")
        found = self._newest(own).filter(not_deleted()).select("key", "val")
        return probes.join(found, "key", "left").withColumn("found", F.col("val").isNotNull())

    def _merge(self, old: dict, names: list[str], level: int, drop_deleted: bool) -> int:
        taken = [r for r in old["runs"] if r["path"] in names]
        merged = self._newest(self.runs(old["version"], names))
        entry = self._write(merged.filter(not_deleted()) if drop_deleted else merged, sum(r["rows"] for r in taken))
        entry |= {"file_seq": max(r["file_seq"] for r in taken), "level": level}
        rest = [r for r in old["runs"] if r["path"] not in names]
        floor = old["next_seq"] - 1 if drop_deleted else old["floor"]
        return self._commit(old, runs=sorted([*rest, entry], key=lambda r: (-r["level"], r["file_seq"])), floor=floor)

    def compact(self, drop_deleted: bool = False) -> int:
        """Merge all runs into one. drop_deleted: deletes go, too, and apply() takes no older mutations from then on."""
        old = self.manifest()
        return self._merge(old, [r["path"] for r in old["runs"]], max([1, *(r["level"] for r in old["runs"])]), drop_deleted) if old["runs"] else old["version"]

    def compact_if_due(self, runs_at_0: int = 4, rows_at_1: int = 10_000_000, factor: int = 10) -> list[int]:
        """Leveled compaction (roadmap operator): as long as a level is due, merge it with the next one; the versions committed.
        Level 0 is due at runs_at_0 runs, level n > 0 at rows_at_1 * factor ** (n - 1) rows."""
        done = []
        while (due := due_level(self.manifest()["runs"], runs_at_0, rows_at_1, factor)) is not None:
            old = self.manifest()
            done.append(self._merge(old, [r["path"] for r in old["runs"] if r["level"] in (due, due + 1)], due + 1, False))
        return done

    def obsolete(self, keep_versions: int = 1) -> list[str]:
        """Runs that none of the newest keep_versions manifests lists."""
        have = self.versions()
        used = {r["path"] for v in have[-keep_versions:] for r in self.manifest(v)["runs"]}
        there = {s.getPath().getName() for s in self._fs.listStatus(self._at())} if self._fs.exists(self._at()) else set()
        return sorted(x for x in there if x.startswith("run-") and x not in used)

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete obsolete runs and old manifests. Readers that pin an older version must have ended."""
        gone = self.obsolete(keep_versions)
        for v in self.versions()[:-keep_versions]:
            self._fs.delete(self._at("manifest", f"v{v}.json"), False)
        for name in gone:
            self._fs.delete(self._at(name), True)
        return gone

    def inspected(self, version: int | None = None) -> DataFrame:
        """A row for each run (roadmap operator): path, level, file_seq, entries, deletes, bytes, first and last key and seq."""
        names = self.spark.createDataFrame([(r["path"], r["level"], r["file_seq"]) for r in self.manifest(version)["runs"]], "path string, level int, file_seq long")
        size = F.octet_length("key") + F.octet_length("val")
        rows = self.runs(version).withColumn("path", F.element_at(F.split(F.input_file_name(), "/"), -2))
        found = rows.groupBy("path").agg(F.count(F.lit(1)).alias("entries"), F.count_if(~not_deleted()).alias("deletes"), F.sum(size).alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
        return names.join(found, "path", "left")


def due_level(entries: list[dict], runs_at_0: int, rows_at_1: int, factor: int) -> int | None:
    """The first level whose runs are to be merged into the next one, or None."""
    for level in sorted({e["level"] for e in entries}):
        own = [e for e in entries if e["level"] == level]
        if len(own) >= runs_at_0 if level == 0 else sum(e["rows"] for e in own) >= rows_at_1 * factor ** (level - 1):
            return level
    return None
