"""Vector collections as merge-on-read tables on any file system that Spark reaches.

A collection is a log of numbered commits beside data folders. An upsert appends its points, a delete appends tombstones, each in
folders by hash bucket of the id; neither reads or rewrites what is there. Reading merges: of an id the row of the last commit counts.
``compact`` writes the merged points of the buckets that have changed, and later reads begin there. A commit is a file that only one
writer can create, so of two writers that race for a number one goes on to the next.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash buckets of a new collection. A compaction rewrites only those that have changed.
BUCKETS = 16
#: Commits since the last compaction from which on ``upsert`` and ``delete`` compact by themselves.
COMPACT_AFTER = 32
#: Points lie in this order within a file, in row groups of about so many bytes with Bloom filters on these columns and the id, so that
#: a search restricted to one document or path passes over most of them.
CLUSTER, ROW_GROUP_BYTES = ("sourcePath", "documentId"), 8 << 20


class StoreError(ValueError):
    """The collection is missing, of another size, or the request is refused."""


class Conflict(StoreError):
    """Another writer's commit came between; nothing of this change is visible."""


def latest(existing: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """existing with changes put over them: by key the last change wins (column seq orders repeated keys)."""
    ranked = newest(changes, key)
    return existing.join(ranked.select(key), key, "left_anti").unionByName(ranked, allowMissingColumns=True)


def newest(changes: DataFrame, key: str = "id") -> DataFrame:
    """Each key of changes once: its row with the greatest seq, without seq."""
    return changes.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where("rn = 1").drop("rn", "seq")


def without(points: DataFrame, where: Column) -> DataFrame:
    """points that the filter does not match; unknown (null) counts as no match."""
    return points.where(~F.coalesce(where, F.lit(False)))


def describe(points: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: points, and the dimensions of their vectors (null without points)."""
    return points.agg(F.count("*").alias("points"), F.max(F.size(vector)).alias("dimensions"))


class Log:
    """Numbered commits below a folder: JSON files that appear whole and are never replaced."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._jvm = spark._jvm  # noqa: SLF001 - the public way to ask any file system
        self._folder = self._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def _file(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, name)

    def read(self) -> list[dict]:
        """Commits in order, each with its number: all since the state that the last compaction holds, and that compaction."""
        if not self._files.exists(self._folder):
            return []
        names = sorted((s.getPath().getName() for s in self._files.listStatus(self._folder) if s.getPath().getName().endswith(".json")), reverse=True)
        out, through = [], 0
        for name in names:
            number = int(name[:-5])
            if number <= through:
                break
            stream = self._files.open(self._file(name))
            try:
                out.append({"number": number, **json.loads(bytes(stream.readAllBytes()).decode())})
            finally:
                stream.close()
            if out[-1]["kind"] == "compact" and not through:
                through = out[-1]["through"]
        return out[::-1]

    def commit(self, number: int, entry: dict) -> bool:
        """Makes the entry commit ``number``; False if that commit exists. The file is written aside and then takes its name in one step."""
        self._files.mkdirs(self._folder)
        aside, target = self._file(f".{uuid.uuid4().hex}"), self._file(f"{number:020d}.json")
        stream = self._files.create(aside, False)
        try:
            stream.write(json.dumps(entry).encode())
        finally:
            stream.close()
        try:
            return self._take(aside, target)
        finally:
            self._files.delete(aside, False)

    def _take(self, aside: object, target: object) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            if self._folder.toUri().getScheme() in (None, "file"):  # a hard link fails where the name is taken
                paths = self._jvm.java.nio.file.Path
                self._jvm.java.nio.file.Files.createLink(paths.of(target.toUri().getPath(), self._none()), paths.of(aside.toUri().getPath(), self._none()))
            else:  # a rename that does not overwrite
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._folder.toUri(), self.spark._jsc.hadoopConfiguration())  # noqa: SLF001
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)  # noqa: SLF001
                options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(aside, target, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _none(self) -> object:
        return self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)  # noqa: SLF001


class Snapshot:
    """What a collection is after its last commit: base folders by bucket, and the deltas over them."""

    def __init__(self, commits: list[dict]) -> None:
        self.number = commits[-1]["number"] if commits else 0
        made = next((c for c in commits if "dimensions" in c), None)
        self.dimensions, self.buckets = (made["dimensions"], made["buckets"]) if made else (None, BUCKETS)
        base = [c for c in commits if c["kind"] == "compact"]
        self.base: dict[str, dict] = base[-1]["base"] if base else {}
        self.through = base[-1]["through"] if base else 0
        self.deltas = [c for c in commits if c["kind"] in ("upsert", "delete") and c["number"] > self.through]


class Collections:
    """Collections below a root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, name: str) -> Log:
        return Log(self.spark, f"{self.root}/{name}/log")

    def snapshot(self, name: str) -> Snapshot:
        """The collection after its last commit; a missing collection raises."""
        found = Snapshot(self._log(name).read())
        if found.dimensions is None:
            raise StoreError(f"no collection {name}")
        return found

    def ensure(self, name: str, dimensions: int) -> None:
        """Creates the collection if it is missing; one of another size is refused, whoever created it."""
        log = self._log(name)
        if not log.read():
            log.commit(1, {"kind": "create", "dimensions": dimensions, "buckets": BUCKETS})
        now = self.snapshot(name)
        if now.dimensions != dimensions:
            raise StoreError(f"{name} has {now.dimensions} dimensions, not {dimensions}")

    def _stored(self, part: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(part["schema"])).parquet(part["path"])

    def read(self, name: str) -> DataFrame | None:
        """The current points; None while there are none. A missing collection raises."""
        return self._merged(self.snapshot(name))

    def _merged(self, now: Snapshot, buckets: list[int] | None = None) -> DataFrame | None:
        """Points of a snapshot (of some buckets): the base without the ids that deltas name, and of the deltas each id's last row.

        Where the deltas are small their ids are broadcast (by Spark's own limit); the base is then read in place.
        """
        pick = lambda df: (df if buckets is None else df.where(F.col("bucket").isin(buckets))).drop("bucket")
        parts: dict[str, dict] = {}
        for bucket, part in now.base.items():
            if buckets is None or int(bucket) in buckets:
                parts.setdefault(json.dumps(part["schema"]), {"schema": part["schema"], "paths": []})["paths"].append(part["path"])
        base = [self.spark.read.schema(T.StructType.fromJson(p["schema"])).parquet(*p["paths"]) for p in parts.values()]
        union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        if not now.deltas:
            return union(base) if base else None
        deltas = union([pick(self._stored(d)).withColumns({"seq": F.lit(d["number"]), "deleted": F.lit(d["kind"] == "delete")}) for d in now.deltas])
        last = newest(deltas)
        kept = last.where("not deleted").drop("deleted")
        if not base:
            return kept if any(d["kind"] == "upsert" for d in now.deltas) else None
        return union(base).join(deltas.select("id").distinct(), "id", "left_anti").unionByName(kept, allowMissingColumns=True)

    def info(self, name: str) -> dict | None:
        """dimensions and number of points; None for a missing collection."""
        try:
            now = self.snapshot(name)
        except StoreError:
            return None
        points = self._merged(now)
        return {"dimensions": now.dimensions, "count": points.count() if points is not None else 0}

    def _append(self, name: str, rows: DataFrame, buckets: int) -> dict:
        """Writes rows by bucket to a new folder; the folder is not part of the collection until a commit names it."""
        path = f"{self.root}/{name}/data/{uuid.uuid4().hex}"
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        cluster = [c for c in CLUSTER if c in rows.columns]
        out = rows.sortWithinPartitions("bucket", *cluster).write.partitionBy("bucket").option("parquet.block.size", ROW_GROUP_BYTES)
        for c in (*cluster, "id"):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(path)
        return {"path": path, "schema": rows.schema.jsonValue()}

    def _commit(self, name: str, entry: dict, number: int, alone: bool = False) -> int:
        """The number under which the entry was committed: ``number``, or a later one unless it must stand ``alone``."""
        log = self._log(name)
        while not log.commit(number, entry):
            if alone:
                raise Conflict(f"{name}: commit {number} was taken by another writer")
            number += 1
        return number

    def upsert(self, name: str, changes: DataFrame) -> None:
        """Puts points (with a column seq) over those with equal id. Writes the changes only; rows without id raise, no rows change nothing."""
        now = self.snapshot(name)
        checked = changes.withColumn("id", F.coalesce("id", F.raise_error(F.lit("a point needs an id")).cast(changes.schema["id"].dataType)))
        part = self._append(name, newest(checked), now.buckets)
        if not self._stored(part).isEmpty():
            self._commit(name, {"kind": "upsert", **part}, now.number + 1)
            self._tidy(name)

    def delete(self, name: str, where: Column | None, attempts: int = 5) -> int:
        """Deletes what the filter matches and says how many; an empty filter is refused.

        The tombstones are those of the snapshot that was read: if another commit comes between, they are found anew.
        """
        if where is None:
            raise StoreError("a delete needs a filter")
        for left in range(attempts - 1, -1, -1):
            now = self.snapshot(name)
            points = self._merged(now)
            if points is None:
                return 0
            part = self._append(name, points.where(where).select("id"), now.buckets)
            n = self._stored(part).count()
            if not n:
                return 0
            try:
                self._commit(name, {"kind": "delete", **part}, now.number + 1, alone=True)
                self._tidy(name)
                return n
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def _tidy(self, name: str) -> None:
        if len(self.snapshot(name).deltas) >= COMPACT_AFTER:
            self.compact(name)

    def compact(self, name: str) -> list[int]:
        """Writes the merged points of the buckets that deltas touch, and says which. Commits that come meanwhile stay deltas over it.

        Of two compactions of the same snapshot both give the same points, so it does not matter whose commit is the later.
        """
        now = self.snapshot(name)
        if not now.deltas:
            return []
        touched = sorted({r[0] for d in now.deltas for r in self._stored(d).select("bucket").distinct().collect()})  # at most ``buckets`` numbers
        merged = self._merged(now, touched)
        if merged is not None:
            merged = merged.repartition(F.pmod(F.xxhash64("id"), F.lit(now.buckets)))  # a file a bucket
        base = {b: p for b, p in now.base.items() if int(b) not in touched}
        if merged is not None:
            part = self._append(name, merged, now.buckets)
            schema = T.StructType([f for f in T.StructType.fromJson(part["schema"]) if f.name != "bucket"]).jsonValue()
            files = self._log(name)._files  # noqa: SLF001
            for b in touched:
                folder = f"{part['path']}/bucket={b}"
                if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder)):  # noqa: SLF001
                    base[str(b)] = {"path": folder, "schema": schema}
        self._commit(name, {"kind": "compact", "through": now.number, "base": base, "dimensions": now.dimensions, "buckets": now.buckets}, now.number + 1)
        return touched

    def vacuum(self, name: str, hours: float = 24.0) -> int:
        """Removes data folders that the collection no longer names and that are older than ``hours``; says how many.

        Readers that began before may still read what a compaction has replaced, and writers what they have not committed yet: both
        must end within that time.
        """
        now, log = self.snapshot(name), self._log(name)
        used = {p["path"].split("/data/")[1].split("/")[0] for p in [*now.base.values(), *now.deltas]}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/data")  # noqa: SLF001
        if not log._files.exists(root):  # noqa: SLF001
            return 0
        before = time.time() * 1000 - hours * 3_600_000
        old = [s.getPath() for s in log._files.listStatus(root) if s.getPath().getName() not in used and s.getModificationTime() <= before]  # noqa: SLF001
        return sum(log._files.delete(p, True) for p in old)  # noqa: SLF001
