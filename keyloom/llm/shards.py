"""Sharding by size-tiered compaction under a versioned manifest, in DataFrame operations alone.

Arrivals become runs of small immutable Parquet shards.  Runs whose sizes differ by less than a factor of `fanout` form a
tier; `fanout` runs of a tier are merged.  Files of at least half the target size are final: no merge reads them again, so
a row is rewritten once a tier, from its arrival up to the target.  A commit writes the next manifest under a name of
its own and moves it to its version's name, which fails if that version exists: readers see one version or the next, and
of two writers one finds itself late and commits on top of the other.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh

#: Age in seconds from which files that no version names are taken for those of a failed writer.
VACUUM_AGE = 24 * 3600


@dataclass(frozen=True)
class Run:
    """Shards that were written together: their files relative to the store, the bytes of each, and the arrivals in them."""

    files: tuple[str, ...]
    sizes: tuple[int, ...]
    arrivals: tuple[int, ...]

    @property
    def bytes(self) -> int:
        return sum(self.sizes)


@dataclass(frozen=True)
class Manifest:
    """A version: the columns of all shards, and the runs."""

    version: int = 0
    schema: StructType | None = None
    runs: tuple[Run, ...] = ()


class Conflict(RuntimeError):
    """Another writer has committed the version that this one wanted."""


def merged_schema(known: StructType | None, new: StructType) -> StructType:
    """The columns of both, in the order of their arrival; ValueError where a name has two types."""
    out = StructType(list(known.fields)) if known else StructType()
    for field in new.fields:
        if field.name not in out.names:
            out.add(field.name, field.dataType, True, field.metadata)
        elif out[field.name].dataType != field.dataType:
            raise ValueError(f"column {field.name!r} is {out[field.name].dataType.simpleString()} in the store and {field.dataType.simpleString()} in the rows")
    return out


class ShardStore:
    """A folder of immutable shards and manifests.

    The driver holds the manifest alone (a line per shard), never rows.  Files of a failed or lost attempt are in no
    manifest, so no reader sees them; vacuum removes them once they are old.  Two writers are safe where moving a file
    to a name that exists fails at once: HDFS and its like, and local disks (where a hard link does it).  A store on
    object storage without such a move takes one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4):
        if target_bytes < 1 or fanout < 2:
            raise ValueError("target_bytes is at least 1 and fanout at least 2")
        self.spark, self.root, self.target_bytes, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    @staticmethod
    def _name(version: int) -> str:
        return f"manifests/v{version:010d}.json"

    # -- versions ---------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """The versions whose manifests are there."""
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json"))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, the newest by default."""
        version = self.version() if version is None else version
        if version == 0:
            return Manifest()
        stream = self._fs.open(self._path(self._name(version)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return Manifest(version, StructType.fromJson(found["schema"]), tuple(Run(tuple(x["files"]), tuple(x["sizes"]), tuple(x["arrivals"])) for x in found["runs"]))

    def runs(self, version: int | None = None) -> list[Run]:
        return list(self.manifest(version).runs)

    def _commit(self, new: Manifest) -> int:
        """Make a manifest the version it says, or raise Conflict if that version is there."""
        body = {"version": new.version, "schema": new.schema.jsonValue(), "runs": [asdict(r) for r in new.runs]}
        name, draft = self._path(self._name(new.version)), self._path(f"manifests/.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path("manifests"))
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(body).encode()))
        finally:
            stream.close()
        try:
            self._move(draft, name)
        except Exception as e:
            if self._fs.exists(name):
                raise Conflict(f"version {new.version} is there") from e
            raise
        finally:
            self._fs.delete(draft, False)
        return new.version

    def _move(self, draft, name) -> None:
        """Give a file a second or a new name that nothing has; fails at once where something has it."""
        if self._fs.getUri().getScheme() == "file":
            local = lambda path: self._jvm.java.io.File(path.toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(local(name), local(draft))
            return
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(draft, name, options)

    def _update(self, change: Callable[[Manifest], Manifest]) -> int:
        """Commit a change of the newest version; on top of another writer's version where that came first."""
        while True:
            base = self.manifest()
            new = change(base)
            if new is base:
                return base.version
            try:
                return self._commit(replace(new, version=base.version + 1))
            except Conflict:
                continue  # every lost race is another writer's success

    # -- writing ----------------------------------------------------------------------------------------------

    def _shards(self, folder: str) -> list[tuple[str, int]]:
        """The shards below a folder, with their bytes."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        out, walk = [], self._fs.listFiles(path, True)
        while walk.hasNext():
            found = walk.next()
            name = found.getPath().toString()
            if name.endswith(".parquet"):
                out.append((folder + name.rpartition(folder)[2], int(found.getLen())))
        return sorted(out)

    def append(self, rows: DataFrame, arrival: str | Column) -> int:
        """Add rows as one run for each value of the integer `arrival`, a column of rows or an expression (null: 0), in one pass and one commit.

        Rows are written where they are, without a shuffle.  Columns that the store lacks are added to it, null in the
        rows before; ValueError, before anything is written, for a column of another type than the store's.  A store
        that gets no rows still learns its columns.
        """
        merged_schema(self.manifest().schema, rows.schema)
        folder, (part,) = f"data/{uuid.uuid4().hex}", fresh(rows, "_arrival")
        value = F.col(f"`{arrival}`") if isinstance(arrival, str) else arrival
        rows.withColumn(part, F.coalesce(value.cast("long"), F.lit(0))).write.partitionBy(part).parquet(f"{self.root}/{folder}")
        by_arrival: dict[int, list[tuple[str, int]]] = {}
        for name, size in self._shards(folder):
            by_arrival.setdefault(int(name.split("/")[2].partition("=")[2]), []).append((name, size))
        new = tuple(Run(tuple(f for f, _ in files), tuple(s for _, s in files), (k,)) for k, files in sorted(by_arrival.items()))

        def change(base: Manifest) -> Manifest:
            schema = merged_schema(base.schema, rows.schema)
            return base if not new and schema == base.schema else Manifest(base.version, schema, base.runs + new)

        return self._update(change)

    def final(self, size: int) -> bool:
        """Whether a file of that many bytes is left alone from now on."""
        return 2 * size >= self.target_bytes

    def tier(self, run: Run) -> int | None:
        """Runs of a tier differ in size by less than a factor of `fanout`; None for a run of final files."""
        if all(map(self.final, run.sizes)):
            return None
        size = max(1, sum(s for s in run.sizes if not self.final(s)))
        return int(math.log(size, self.fanout) + 1e-9)

    def compact(self) -> int:
        """Merge tiers of `fanout` runs or more, the smallest first, until there is none; each merge is a commit of its own."""
        while True:
            tiers: dict[int, list[Run]] = {}
            known = self.manifest()
            for run in known.runs:
                if (tier := self.tier(run)) is not None:
                    tiers.setdefault(tier, []).append(run)
            full = min((k for k, own in tiers.items() if len(own) >= self.fanout), default=None)
            if full is None:
                return known.version
            merged = tiers[full]
            new = self._merge(merged, known.schema)

            def change(base: Manifest, merged=merged, new=new) -> Manifest:
                if not set(merged) <= set(base.runs):  # another writer has merged some of them: its version stands
                    return base
                return Manifest(base.version, base.schema, tuple(r for r in base.runs if r not in merged) + new)

            self._update(change)

    def _merge(self, runs: list[Run], schema: StructType) -> tuple[Run, ...]:
        """The rows of several runs anew, in files of about the target size; final files stay as they are.

        Partitions of the read are joined into as many tasks as there are files to write, not shuffled.
        """
        arrivals = tuple(sorted({a for r in runs for a in r.arrivals}))
        files = [(f, s) for r in runs for f, s in zip(r.files, r.sizes, strict=True)]
        kept, small = [x for x in files if self.final(x[1])], [x for x in files if not self.final(x[1])]
        folder = f"data/{uuid.uuid4().hex}"
        n = max(1, round(sum(s for _, s in small) / self.target_bytes))
        self._read([f for f, _ in small], schema).coalesce(n).write.parquet(f"{self.root}/{folder}")
        made = self._shards(folder)
        done = kept + [x for x in made if self.final(x[1])]
        rest = [x for x in made if not self.final(x[1])]
        return tuple(Run(tuple(f for f, _ in own), tuple(s for _, s in own), arrivals) for own in (done, rest) if own)

    # -- reading ----------------------------------------------------------------------------------------------

    def _read(self, files: list[str], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the columns that the store had then; ValueError before the first version."""
        found = self.manifest(version)
        if found.schema is None:
            raise ValueError("the store is empty")
        return self._read([f for r in found.runs for f in r.files], found.schema)

    def vacuum(self, keep: int = 1, older_than_s: float = VACUUM_AGE) -> None:
        """Delete shards that none of the newest `keep` versions names, and manifests before those.

        Shards and manifests younger than older_than_s stay: a writer may have yet to commit them, a reader may be at
        work on them.
        """
        there = self.versions()
        live = {f for v in there[-keep:] for r in self.runs(v) for f in r.files}
        if not self._fs.exists(self._path("data")):
            return

        def old(status) -> bool:
            return time.time() - status.getModificationTime() / 1000 >= older_than_s

        folders = {f.split("/")[1] for f in live}
        for x in self._fs.listStatus(self._path("data")):
            name = x.getPath().getName()
            if name not in folders:
                if old(x):
                    self._fs.delete(x.getPath(), True)
                continue
            for shard, _ in self._shards(f"data/{name}"):
                if shard not in live and old(self._fs.getFileStatus(self._path(shard))):
                    self._fs.delete(self._path(shard), False)
        for v in there[:-keep]:
            if old(self._fs.getFileStatus(self._path(self._name(v)))):
                self._fs.delete(self._path(self._name(v)), False)


def shard(rows: DataFrame, arrival: Column, root: str, target_bytes: int = 128 << 20, fanout: int = 4) -> ShardStore:
    """Store rows by arrival (a Column) and compact; the store can be read at once.

    Defined cases: nulls, repeated rows and texts of any length are stored as they are; a null arrival is arrival 0; an
    empty table leaves a store without rows, which reads as an empty table of its columns; other columns, whatever their
    names, are kept.  Nothing is vacuumed: the shards that were merged stay until the caller's vacuum finds them old.
    """
    store = ShardStore(rows.sparkSession, root, target_bytes, fanout)
    store.append(rows, arrival)
    store.compact()
    return store
