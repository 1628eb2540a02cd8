"""Builds of a database: under a lock, skipped while fresh, with counters while they run."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trawl.functions.display import FRESH_BUILD, STALE_BUILD
from trawl.operators.index import ContentIndex
from trawl.sources.files import scan
from trawl.sources.store import SnapshotStore, index_path
from trawl.sources.walk import is_walkable, walk

SAFETY_NET = 86_400


def build(spark: SparkSession, root: str, store: SnapshotStore, force: bool = False, now: float | None = None, index: bool = False, **options) -> dict | None:
    """Scan root and publish it as the store's new version; options go to ``scan``.

    None while another build holds the lock. A version younger than a minute is kept unless forced. The counters are
    observed on the rows as they are written, so the tree is read once. With ``index``, the version's content index is
    written beside it.
    """
    current, now = store.manifest(), time.time() if now is None else now
    if current and not force and now - current["build_time"] < FRESH_BUILD:
        return current
    store.sweep()
    if not store.lock():
        return None
    try:
        seen = Observation("build")
        count = lambda g: F.count_if(F.col("gate") == g)
        walked, denied = None, None
        if is_walkable(root):
            walked = walk(spark, root, **{k: v for k, v in options.items() if k in ("skip", "ignore", "hidden", "use_ignore_files")})
            denied = walked.filter("denied").count()
        rows = scan(spark, root, walked=walked, **options).observe(
            seen, F.count(F.lit(1)).alias("filename_docs"), count("text").alias("content_docs"), count("binary").alias("skipped_binary"), count("large").alias("skipped_large"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("content_bytes")
        )
        made = store.publish(rows, facts=lambda: seen.get | {"denied": denied})
        if index:
            ContentIndex.build(store.snapshot().drop("gate"), index_path(made["version"]))
        return made
    finally:
        store.unlock()


class BackgroundBuild:
    """A build in a thread of its own; searches go on with the version there is."""

    def __init__(self, run: Callable[[], dict | None]):
        self.made: dict | None = None
        self.error: Exception | None = None

        def work() -> None:
            try:
                self.made = run()
            except Exception as e:  # told by result()
                self.error = e

        self.thread = threading.Thread(target=work, daemon=True)
        self.thread.start()

    def done(self) -> bool:
        return not self.thread.is_alive()

    def result(self, timeout: float | None = None) -> dict | None:
        """The manifest once the build has ended; raises what it raised, or TimeoutError."""
        self.thread.join(timeout)
        if self.thread.is_alive():
            raise TimeoutError("the build is still running")
        if self.error:
            raise self.error
        return self.made


def spawn_build(spark: SparkSession, root: str, store: SnapshotStore, **options) -> BackgroundBuild | None:
    """Start a build in the background; None while another one of this store runs. Its state is ``store.is_building()``."""
    store.sweep()
    return None if store.is_building() else BackgroundBuild(lambda: build(spark, root, store, **options))


def spawn_if_missing(spark: SparkSession, root: str, store: SnapshotStore, **options) -> BackgroundBuild | None:
    """Start a build in the background where there is no version yet."""
    return None if store.manifest() else spawn_build(spark, root, store, **options)


def build_if_missing(spark: SparkSession, root: str, store: SnapshotStore, **options) -> dict | None:
    return store.manifest() or build(spark, root, store, **options)


def is_stale(store: SnapshotStore, now: float | None = None) -> bool:
    """Whether a search should warn that the version is older than a week."""
    current = store.manifest()
    return bool(current) and (time.time() if now is None else now) - current["build_time"] > STALE_BUILD


def safety_net(spark: SparkSession, root: str, store: SnapshotStore, every: int = SAFETY_NET, stop: Callable[[], bool] = lambda: False, **options) -> None:
    """Rebuild every so many seconds until stop(); the overlay stays, for it may hold changes the scan did not see."""
    while not stop():
        build(spark, root, store, force=True, **options)
        deadline = time.time() + every
        while time.time() < deadline and not stop():
            time.sleep(min(1.0, max(0.0, deadline - time.time())))


def counters(report: dict) -> str:
    """One line of a build's counters."""
    return f"{report['filename_docs']} files, {report['content_bytes'] / 1e6:.1f} MB of {report['content_docs']} contents, {report['skipped_binary']} binary, {report['skipped_large']} large"


def report_frame(spark: SparkSession, manifest: dict) -> DataFrame:
    names = ("filename_docs", "content_docs", "denied", "skipped_binary", "skipped_large")
    return spark.createDataFrame([tuple(manifest.get(n) for n in names)], ", ".join(f"{n} bigint" for n in names))
