"""Versioned snapshots, the registry of databases and settings; pointers are swapped atomically on any Hadoop store."""

from __future__ import annotations

import atexit
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.display import status_state


LOCAL_SCRATCH = "/tmp/checkpoints/trawl"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of its own on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_SCRATCH


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_discard, spark, path)
    return path


def _discard(spark: SparkSession, path: str) -> None:
    try:
        FileStore(spark).delete(path)
    except Exception:  # the session has ended; the shared folder's own clean-up takes it
        pass


class FileStore:
    """Small text files through Hadoop's file system, so driver and executors see the same store."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def read(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        stream = self._fs(path).open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file; False if there is one."""
        fs = self._fs(path)
        fs.mkdirs(self._path(path).getParent())
        try:
            stream = fs.create(self._path(path), False)
        except Exception as e:
            if "already exists" in str(e).lower() or "FileAlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Swap a file's whole text: a reader sees the old or the new."""
        new = f"{path}.{uuid.uuid4().hex}"
        self.create(new, text)
        at, options = self._path(path), self.jvm.org.apache.hadoop.fs.Options
        renames = self.jvm.java.lang.reflect.Array.newInstance(options.Rename.OVERWRITE.getClass(), 1)
        renames[0] = options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs(path).getUri(), self.conf).rename(self._path(new), at, renames)

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def folders(self, path: str) -> list[str]:
        """The folders directly under path."""
        if not self.exists(path):
            return []
        return [s.getPath().toString() for s in self._fs(path).listStatus(self._path(path)) if s.isDirectory()]


class SnapshotStore:
    """Versions of a files table under root; MANIFEST.json names the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), FileStore(spark)

    def manifest(self) -> dict | None:
        text = self.files.read(f"{self.root}/MANIFEST.json")
        return json.loads(text) if text else None

    def publish(self, files: DataFrame, facts: Callable[[], dict] = dict) -> dict:
        """Write files as a new version and point the manifest at it; readers of the version before keep it.

        Versions older than that are removed. facts() is asked after the write and goes into the manifest.
        """
        path = f"{self.root}/v={time.time_ns()}-{uuid.uuid4().hex[:8]}"
        files.write.option("compression", "zstd").parquet(path)
        written = self.spark.read.parquet(path)
        before = self.manifest() or {}
        manifest = {"version": path, "before": before.get("version"), "build_time": int(time.time()), "docs": written.count()} | facts()
        self.files.replace(f"{self.root}/MANIFEST.json", json.dumps(manifest))
        if before.get("before"):  # the version just replaced stays for its readers, the one before it goes
            self.files.delete(before["before"])
            self.files.delete(index_path(before["before"]))
        return manifest

    def snapshot(self) -> DataFrame | None:
        """The current version, pinned: a later publish does not change this DataFrame."""
        manifest = self.manifest()
        return self.spark.read.parquet(manifest["version"]) if manifest else None

    def lock(self) -> bool:
        """Take the build lock; False while another build holds it."""
        return self.files.create(f"{self.root}/BUILDING", json.dumps({"since": int(time.time())}))

    def unlock(self) -> None:
        self.files.delete(f"{self.root}/BUILDING")

    def sweep(self, older_than: int = 86_400) -> bool:
        """Remove a lock that a dead build left."""
        text = self.files.read(f"{self.root}/BUILDING")
        stale = bool(text) and json.loads(text)["since"] < time.time() - older_than
        if stale:
            self.unlock()
        return stale

    def is_building(self) -> bool:
        return self.files.exists(f"{self.root}/BUILDING")


def index_path(version: str) -> str:
    """Where the content index of a version lies."""
    return f"{version}.index"


@dataclass(frozen=True)
class Database:
    name: str
    root: str
    path: str


@dataclass
class Registry:
    """Named databases in one JSON file, read anew for every query."""

    records: list[Database] = field(default_factory=list)

    @classmethod
    def load(cls, store: FileStore, path: str) -> Registry:
        return cls([Database(**r) for r in json.loads(store.read(path) or "[]")])

    def save(self, store: FileStore, path: str) -> None:
        store.replace(path, json.dumps([asdict(r) for r in self.records]))

    def upsert(self, record: Database) -> None:
        self.records = [r for r in self.records if r.name != record.name] + [record]

    def remove(self, name: str) -> bool:
        before = len(self.records)
        self.records = [r for r in self.records if r.name != name]
        return len(self.records) < before

    def get(self, name: str) -> Database:
        for r in self.records:
            if r.name == name:
                return r
        raise ValueError(f"no database {name!r}; there are: {', '.join(r.name for r in self.records)}")


@dataclass
class Settings:
    """Ignore patterns; unknown keys are passed over and missing ones have defaults."""

    ignore: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, store: FileStore, path: str) -> Settings:
        try:
            found = json.loads(store.read(path) or "{}")
        except ValueError:
            found = {}
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in found.items() if k in known}) if isinstance(found, dict) else cls()

    def save(self, store: FileStore, path: str) -> None:
        store.replace(path, json.dumps(asdict(self)))

    def add(self, pattern: str) -> bool:
        pattern = pattern.strip()
        if not pattern or pattern in self.ignore:
            return False
        self.ignore.append(pattern)
        return True

    def remove(self, pattern: str) -> bool:
        if pattern not in self.ignore:
            return False
        self.ignore.remove(pattern)
        return True


def status(spark: SparkSession, databases: list[Database], now: int | None = None) -> DataFrame:
    """name, docs, build_time, state of every database."""
    rows = []
    for d in databases:
        store = SnapshotStore(spark, d.path)
        m = store.manifest() or {}
        rows.append((d.name, m.get("docs"), m.get("build_time"), store.is_building()))
    df = spark.createDataFrame(rows, "name string, docs bigint, build_time bigint, indexing boolean")
    age = F.lit(int(now if now is not None else time.time())) - F.col("build_time")
    return df.select("name", "docs", "build_time", status_state(age, F.col("indexing")).alias("state"))
