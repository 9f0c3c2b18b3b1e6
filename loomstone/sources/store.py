"""A persistent store: versioned Parquet snapshots, a pointer to the current one, and a log of batches since.

``root/snapshots/v=N`` holds entities, ``root/indexes/v=N`` their index frames; ``root/log/b=K`` holds a batch of operations; ``root/CURRENT`` names the snapshot and
the first batch that it does not cover, and is replaced by a rename. Reading is the snapshot and the replay of later
batches; batches that a snapshot covers are ignored even if deleting them failed, so no crash between two steps loses or
repeats an operation. Any store that Hadoop's file systems reach will do."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from loomstone.corpus import INDEXES, Corpus
from loomstone.errors import (
    EntityAlreadyExists,
    InvalidFormat,
    InvalidInput,
    InvalidOutputPath,
    LeftDatabaseMissing,
    OutputExists,
    OutputInputCollision,
    RightDatabaseMissing,
    StorageLimit,
    StoreError,
    UnsupportedVersion,
)
from loomstone.operators import lifecycle
from loomstone.operators.search import search
from loomstone.schema import ENTITY, conform
from loomstone.sources.scratch import numbered
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
LOG = f"seq bigint, op string, {ENTITY}"
ENTITY_COLUMNS = ("entity_id", "ord", "aliases", "tags", "attributes", "relationships", "sources")
#: Where a store is, if nothing else is said.
DEFAULT_PATH = "loomstone.store"


@dataclass
class Config:
    name: str
    max_segment_size: int = 64 << 20
    max_segments: int = 16
    index_from: int = 8 << 20  # bytes: index frames of a smaller snapshot are made when they are asked for


class Files:
    """What the store needs of a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    def mkdirs(self, p: str) -> None:
        self.fs.mkdirs(self._path(p))

    def delete(self, p: str) -> None:
        self.fs.delete(self._path(p), True)

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(p))) if self.exists(p) else []

    def size(self, p: str) -> int:
        return self.fs.getContentSummary(self._path(p)).getLength() if self.exists(p) else 0

    def read(self, p: str) -> str:
        stream = self.fs.open(self._path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, p: str, text: str) -> None:
        """Writes beside p, then puts it in p's place."""
        beside = f"{p}.{time.time_ns()}.tmp"
        out = self.fs.create(self._path(beside), True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(p).toUri() if "://" in p else self.fs.getUri(), self.conf)
        flags = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        flags[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(context.makeQualified(self._path(beside)), context.makeQualified(self._path(p)), flags)


class EntityStore:
    def __init__(self, spark: SparkSession, root: str, config: Config):
        self.spark, self.root, self.config, self.files = spark, root.rstrip("/"), config, Files(spark, root)

    # opening

    @classmethod
    def create(cls, spark: SparkSession, parent: str, name: str, **config) -> EntityStore:
        root = f"{parent.rstrip('/')}/{name}"
        store = cls(spark, root, Config(name, **config))
        if store.files.exists(f"{root}/CURRENT"):
            raise OutputExists(f"output exists: {root}")
        store.files.mkdirs(root)
        store.files.replace(f"{root}/config.json", json.dumps({"version": VERSION} | asdict(store.config)))
        spark.createDataFrame([], ENTITY).write.mode("overwrite").parquet(f"{root}/snapshots/v=0")
        store._point(0, 0)
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> EntityStore:
        files, root = Files(spark, root), root.rstrip("/")
        if not files.exists(f"{root}/CURRENT"):
            raise InvalidFormat(f"no store at {root}")
        found = json.loads(files.read(f"{root}/config.json"))
        if found.pop("version", None) != VERSION:
            raise UnsupportedVersion(f"a store of another version at {root}")
        return cls(spark, root, Config(**found))

    @classmethod
    def at(cls, spark: SparkSession, root: str = DEFAULT_PATH, **config) -> EntityStore:
        """The store at a path, made if there is none."""
        root = root.rstrip("/")
        if Files(spark, root).exists(f"{root}/CURRENT"):
            return cls.open(spark, root)
        parent, _, name = root.rpartition("/")
        return cls.create(spark, parent or ".", name, **config)

    def _current(self) -> tuple[int, int]:
        c = json.loads(self.files.read(f"{self.root}/CURRENT"))
        return c["snapshot"], c["first_batch"]

    def _point(self, snapshot: int, first_batch: int) -> None:
        self.files.replace(f"{self.root}/CURRENT", json.dumps({"snapshot": snapshot, "first_batch": first_batch}))

    def _batches(self) -> list[int]:
        """Complete batches that the snapshot does not cover."""
        first = self._current()[1]
        found = [int(n[2:]) for n in self.files.names(f"{self.root}/log") if n.startswith("b=") and self.files.exists(f"{self.root}/log/{n}/_SUCCESS")]
        return [b for b in found if b >= first]

    def next_batch(self) -> int:
        return max([*self._batches(), self._current()[1] - 1]) + 1

    # reading

    def snapshot(self) -> DataFrame:
        return self.spark.read.schema(ENTITY).parquet(f"{self.root}/snapshots/v={self._current()[0]}")

    def log(self, batches: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/log/b={b}" for b in (self._batches() if batches is None else batches)]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def entities(self) -> DataFrame:
        """The current state: the snapshot with what the log says since."""
        return lifecycle.replay(self.snapshot(), self.log()) if self._batches() else self.snapshot()

    def corpus(self) -> Corpus:
        """The entities with the index frames of the snapshot, in which those that the log names are replaced."""
        at = f"{self.root}/indexes/v={self._current()[0]}"
        if not self.files.exists(f"{at}/{INDEXES[-1]}/_SUCCESS"):
            return Corpus(self.entities())
        indexed = Corpus.at(self.spark, at, self.snapshot())
        return indexed.changed(self.log().select("entity_id").distinct(), self.entities()) if self._batches() else indexed

    def search(self, queries, limit: int | None = None) -> DataFrame:
        return search(self.corpus(), queries, limit)

    def entity(self, entity_id: int) -> DataFrame:
        return self.entities().where(F.col("entity_id") == entity_id)

    def stats(self) -> DataFrame:
        return self.corpus().stats()

    def size(self) -> int:
        return self.files.size(self.root)

    # writing

    def write_batch(self, b: int, rows: DataFrame, *order: str) -> None:
        """Writes batch b of the log: rows (op and the columns of an entity) with sequence numbers that go on after those of the
        batches before it."""
        earlier = [x for x in self._batches() if x < b]
        last = self.log(earlier).agg(F.max("seq")).first()[0] if earlier else None
        unordered = f"{self.root}/log/_{b}"
        rows = numbered(rows, unordered, "seq", *order).withColumn("seq", F.col("seq") + F.lit(0 if last is None else last + 1))
        rows.select("seq", "op", *ENTITY_COLUMNS).write.mode("overwrite").parquet(f"{self.root}/log/b={b}")
        self.files.delete(unordered)

    def _append(self, op: str, rows: DataFrame) -> None:
        """Sequence numbers follow the order of the batch. If more than ``max_segment_size`` bytes of log are pending, these are
        flushed into a snapshot first."""
        if self.files.size(f"{self.root}/log") > self.config.max_segment_size:
            self.flush()
        self.write_batch(self.next_batch(), conform(rows).withColumn("op", F.lit(op)), "ord", "entity_id")

    def insert(self, batch: DataFrame) -> None:
        if found := lifecycle._ids(lifecycle.existing(self.entities(), batch)):
            raise EntityAlreadyExists(found)
        self._append("insert", batch)

    def update(self, batch: DataFrame) -> None:
        lifecycle.update(self.entities(), batch)  # checks
        self._append("update", batch)

    def remove(self, ids: DataFrame | list[int]) -> None:
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "entity_id bigint")
        lifecycle.remove(self.entities(), ids)  # checks
        self._append("remove", ids)

    def flush(self) -> None:
        """Writes a snapshot of the current state and points to it; the log starts anew."""
        version, batches = self._current()[0], self._batches()
        if not batches:
            return
        if len(self.files.names(f"{self.root}/snapshots")) >= self.config.max_segments:
            raise StorageLimit(f"{self.config.max_segments} snapshots are kept at most; compact first")
        self.entities().write.mode("overwrite").parquet(f"{self.root}/snapshots/v={version + 1}")
        self._index(version + 1)
        self._point(version + 1, batches[-1] + 1)
        for b in batches:
            self.files.delete(f"{self.root}/log/b={b}")

    def _index(self, version: int) -> None:
        """Writes the index frames of a snapshot, unless it is small; those of older ones than the current one go."""
        if self.files.size(f"{self.root}/snapshots/v={version}") >= self.config.index_from:
            snapshot = self.spark.read.schema(ENTITY).parquet(f"{self.root}/snapshots/v={version}")
            Corpus(snapshot).indexed(f"{self.root}/indexes/v={version}", snapshot)
        for name in self.files.names(f"{self.root}/indexes"):
            if int(name[2:]) < version - 1:
                self.files.delete(f"{self.root}/indexes/{name}")

    def compact(self, per_file: int = 5_000_000) -> tuple[int, int]:
        """Rewrites the current state in files of about so many entities, deletes other snapshots and covered batches.
        Bytes before and after."""
        before = self.size()
        version, batches = self._current()[0], self._batches()
        self.entities().write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(f"{self.root}/snapshots/v={version + 1}")
        self._index(version + 1)
        self._point(version + 1, self.next_batch())
        for name in self.files.names(f"{self.root}/snapshots"):
            if name != f"v={version + 1}":
                self.files.delete(f"{self.root}/snapshots/{name}")
                self.files.delete(f"{self.root}/indexes/{name}")
        for b in batches:
            self.files.delete(f"{self.root}/log/b={b}")
        return before, self.size()


def build(spark: SparkSession, entities: DataFrame, parent: str, name: str, **config) -> EntityStore:
    """A new store with these entities."""
    store = EntityStore.create(spark, parent, name, **config)
    store.insert(entities)
    store.flush()
    return store


def merge_stores(spark: SparkSession, left: str, right: str, output: str) -> lifecycle.MergeReport:
    """A new store at output with all of left and what right has besides. Checked in this order: the inputs differ, output
    is neither of them, left is there, right is there, output is not."""
    left, right, output = (p.rstrip("/") for p in (left, right, output))
    if left == right:
        raise InvalidInput("the input databases are the same")
    if output in (left, right):
        raise OutputInputCollision("the output database is one of the inputs")
    parent, _, name = output.rpartition("/")
    if not name:
        raise InvalidOutputPath(f"invalid output path: {output}")
    files = Files(spark, parent or "/")
    for path, error in ((left, LeftDatabaseMissing), (right, RightDatabaseMissing)):
        if not files.exists(f"{path}/CURRENT"):
            raise error(f"database missing: {path}")
    if files.exists(output):
        raise OutputExists(f"output exists: {output}")
    a, b = EntityStore.open(spark, left).entities(), EntityStore.open(spark, right).entities()
    r = lifecycle.merge_report(a, b).first()
    build(spark, lifecycle.merge(a, b), parent, name)
    return lifecycle.MergeReport(r["entities_added"], r["entities_skipped"])


__all__ = ["Config", "EntityStore", "StoreError", "build", "merge_stores"]
