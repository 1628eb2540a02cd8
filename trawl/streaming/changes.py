"""Structured Streaming over a change log: latest change of every path, durable and replayable.

The log is a directory of Parquet files, the checkpoint remembers what was read, and every micro-batch adds its own
last changes as one delta, named by the batch's number; so a batch that runs twice writes the same delta again. Deltas
are merged when read, and folded into one now and then. What a compaction has taken up is remembered by path and
number, so a change that comes late to a path is lost only if a later one of that path was there before.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.patterns import IgnoreRule
from trawl.model import CHANGES
from trawl.operators.overlay import META, live, merged, needs_compaction
from trawl.sources.files import SIZE_CAP, gate, kept, lossy
from trawl.sources.store import FileStore, SnapshotStore
from trawl.sources.walk import file_system, walk

DEBOUNCE, COMPACT_AT = "300 milliseconds", 2000
#: Deltas from which on they are folded into one.
FOLD_AT = 32
#: Seconds after which another process's hold on the pointer counts as dead.
DEAD = 60
STATE = T.StructType([*CHANGES.fields])
APPLIED = T.StructType([f for f in CHANGES.fields if f.name in ("seq", "path")])


def _last(rows: DataFrame) -> DataFrame:
    """The change of the highest number of every path."""
    picked = rows.groupBy("path").agg(F.max_by(F.struct("seq", "op", *META), "seq").alias("l"))
    return picked.select("l.seq", "l.op", "path", *[f"l.{c}" for c in META])


class Overlay:
    """The overlay's deltas under root; OVERLAY.json names them, the last batch and the changes that were compacted."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), FileStore(spark)

    def pointer(self) -> dict:
        return {"batch": -1, "deltas": [], "applied": None, "old": []} | json.loads(self.files.read(f"{self.root}/OVERLAY.json") or "{}")

    def _swap(self, change: Callable[[dict], dict]) -> None:
        """Replace the pointer by what change() makes of it; one process at a time.

        Folders that leave it stay until the next swap that drops any, for those who read them now.
        """
        lock, since = f"{self.root}/SWAPPING", time.time()
        while not self.files.create(lock, "") and time.time() - since < DEAD:
            time.sleep(0.05)
        try:
            before = self.pointer()
            after = change(dict(before))
            gone = [x for x in (*before["deltas"], before["applied"]) if x and x not in (*after["deltas"], after["applied"])]
            dead = [x for x in before["old"] if x not in (*after["deltas"], after["applied"])] if gone else []
            self.files.replace(f"{self.root}/OVERLAY.json", json.dumps(after | {"old": gone or before["old"]}))
            for x in dead:
                self.files.delete(x)
        finally:
            self.files.delete(lock)

    def _deltas(self, p: dict) -> DataFrame:
        """The last change of every path in the deltas, without those that a compaction has taken up."""
        if not p["deltas"]:
            return self.spark.createDataFrame([], STATE)
        last = _last(self.spark.read.schema(STATE).parquet(*p["deltas"]))
        if not p["applied"]:
            return last
        done = self.spark.read.schema(APPLIED).parquet(p["applied"]).select("path", F.col("seq").alias("done"))
        return last.join(done, "path", "left").filter(F.col("done").isNull() | (F.col("seq") > F.col("done"))).select(*STATE.fieldNames())

    def state(self) -> DataFrame:
        """The last change of every path since the last compaction."""
        return self._deltas(self.pointer())

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch: the highest seq of every path wins, whatever order the batches bring."""
        p = self.pointer()
        if batch_id <= p["batch"]:
            return
        delta = f"{self.root}/batch={batch_id}"
        _last(batch.select(*STATE.fieldNames())).write.mode("overwrite").parquet(delta)
        self._swap(lambda q: q | {"batch": max(batch_id, q["batch"]), "deltas": [*[d for d in q["deltas"] if d != delta], delta]})
        if len(p["deltas"]) + 1 >= FOLD_AT:
            self.fold()

    def fold(self) -> None:
        """Write all deltas as one."""
        p = self.pointer()
        whole = f"{self.root}/fold={time.time_ns()}"
        self._deltas(p).write.parquet(whole)
        self._swap(lambda q: q | {"deltas": [whole, *[d for d in q["deltas"] if d not in p["deltas"]]]})

    def clear(self, p: dict) -> None:
        """Drop what a compaction of the pointer ``p`` took up; what came meanwhile, or comes late, stays."""
        done = self._deltas(p).select("seq", "path")
        if p["applied"]:
            done = done.unionByName(self.spark.read.schema(APPLIED).parquet(p["applied"]))
        applied = f"{self.root}/applied={time.time_ns()}"
        done.groupBy("path").agg(F.max("seq").alias("seq")).select("seq", "path").write.parquet(applied)
        self._swap(lambda q: q | {"deltas": [d for d in q["deltas"] if d not in p["deltas"]], "applied": applied})


def read_changes(spark: SparkSession, log: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CHANGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(log)


def watch(spark: SparkSession, log: str, root: str, rules=None, rebuild_at: int | None = None, cold: str | None = None, files_per_batch: int | None = None, once: bool = False):
    """Start the stream that keeps the overlay under root. rules(): ignore rules, read anew for every batch.

    With a cold store and a threshold, a batch that makes the overlay that long is followed by a compaction. ``once``
    takes what there is and ends.
    """
    overlay = Overlay(spark, root)

    def handle(batch: DataFrame, batch_id: int) -> None:
        found: list[IgnoreRule] = rules() if rules else []
        overlay.apply(batch.filter(kept(F.regexp_replace("path", "^/+", ""), F.col("is_dir"), rules=found, hidden=True)), batch_id)
        if cold and needs_compaction(overlay.state(), rebuild_at or COMPACT_AT):
            compact(spark, overlay, SnapshotStore(spark, cold))

    writer = read_changes(spark, log, files_per_batch).writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def _inspect(root: str, cap: int):
    def run(batches):
        store, _ = file_system(root)
        for batch in batches:
            paths, rows = batch.column(1).to_pylist(), []
            for info in store.get_file_info(paths):
                data = None
                if info.is_file and info.size <= cap:
                    try:
                        with store.open_input_stream(info.path) as f:
                            data = f.read()
                    except OSError:
                        data = None
                there = info.type != pafs.FileType.NotFound
                rows.append((there, info.type == pafs.FileType.Directory, info.size or 0, info.mtime_ns // 1_000_000_000 if there and info.mtime_ns else 0, data))
            kinds = [pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["seq", "path", "there", "is_dir", "size", "mtime", "data"])

    return run


def records_of(touched: DataFrame, root: str, cap: int = SIZE_CAP) -> DataFrame:
    """Change records of touched(seq, path) as the files are now: gone ones are deletes; directories, binary and large
    files are upserts without content. The files are read on the executors."""
    seen = touched.select(F.col("seq").cast("bigint").alias("seq"), "path").mapInArrow(_inspect(root, cap), "seq bigint, path string, there boolean, is_dir boolean, size bigint, mtime bigint, data binary")
    judged = seen.withColumn("gate", gate(F.col("size"), F.col("data"), cap))
    text = F.when(~F.col("is_dir") & (F.col("gate") == "text"), lossy(F.col("data")))
    return judged.select("seq", F.when(F.col("there"), "upsert").otherwise("delete").alias("op"), "path", "is_dir", "size", "mtime", text.alias("content"))


def touched(view: DataFrame, walked: DataFrame, seq: int) -> DataFrame:
    """(seq, path) of what differs between a view of the files and a new walk of the tree: added, gone, or of another
    kind, size or time. Both sides meet by path in one shuffle; contents are not read."""
    old = view.select("path", F.struct("is_dir", F.when(F.col("is_dir"), 0).otherwise(F.col("size")).alias("size"), F.when(F.col("is_dir"), 0).otherwise(F.col("mtime")).alias("mtime")).alias("was"))
    new = walked.filter("NOT denied").select("path", F.struct("is_dir", F.when(F.col("is_dir"), 0).otherwise(F.col("size")).alias("size"), F.when(F.col("is_dir"), 0).otherwise(F.col("mtime")).alias("mtime")).alias("now"))
    return old.join(new, "path", "full").filter(~F.col("was").eqNullSafe(F.col("now"))).select(F.lit(seq).cast("bigint").alias("seq"), "path")


def capture(spark: SparkSession, root: str, view: DataFrame, log: str, own: tuple[str, ...] = (), cap: int = SIZE_CAP, **options) -> None:
    """Append to the log what has changed under root since ``view``: what a watcher would have told.

    Numbers are nanoseconds, so later captures win. Paths under the folders ``own`` (the store's, the log's) are passed
    over, or every capture would cause the next. Options go to ``walk``.
    """
    found = touched(view, walk(spark, root, **options), time.time_ns())
    for folder in own:
        found = found.filter(~((F.col("path") == folder.rstrip("/")) | F.col("path").startswith(folder.rstrip("/") + "/")))
    append_log(records_of(found, root, cap), log)


def read_json_log(spark: SparkSession, log: str) -> DataFrame:
    """A log of JSON lines, of each file only what stands before its first damaged line."""
    bad = T.StructField("_corrupt_record", T.StringType())
    raw = spark.read.text(log).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    parsed = raw.select(F.struct("block", "nth").alias("at"), "file", F.from_json("value", T.StructType([*CHANGES.fields, bad]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    torn = F.col("r._corrupt_record").isNotNull() | F.col("r.seq").isNull() | F.col("r.op").isNull() | F.col("r.path").isNull()
    ends = parsed.filter(torn).groupBy("file").agg(F.min("at").alias("cut"))
    kept_rows = parsed.join(ends, "file", "left").filter(F.col("cut").isNull() | (F.col("at") < F.col("cut")))
    return kept_rows.select(*[F.col(f"r.{c}") for c in CHANGES.fieldNames()])


def append_log(changes: DataFrame, log: str) -> None:
    changes.select(*CHANGES.fieldNames()).write.mode("append").parquet(log)


def current(overlay: Overlay, cold: DataFrame, db: str | None = None) -> DataFrame:
    """The merged view: cold under the overlay. Changes have no gate, so the view has none."""
    return merged(cold.drop("gate"), overlay.state(), db=db)


def compact(spark: SparkSession, overlay: Overlay, store: SnapshotStore) -> dict | None:
    """Publish the merged view as the new cold version and empty the overlay; None while another build holds the lock.

    Changes that are applied meanwhile stay in the overlay.
    """
    if not store.lock():
        return None
    try:
        cold, p = store.snapshot(), overlay.pointer()
        cold = cold.drop("gate") if cold is not None else None  # changes have none
        state = overlay._deltas(p)
        view = merged(cold, state) if cold is not None else live(state).select(F.lit(None).cast("string").alias("db"), "path", *META)
        manifest = store.publish(view)
        overlay.clear(p)
        return manifest
    finally:
        store.unlock()


def latest_of_stream(spark: SparkSession, log: str, root: str, files_per_batch: int = 1) -> DataFrame:
    """Run the stream over all of the log and return its state."""
    query = watch(spark, log, root, files_per_batch=files_per_batch, once=True)
    query.awaitTermination()
    return Overlay(spark, root).state()
