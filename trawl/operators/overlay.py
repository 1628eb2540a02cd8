"""Incremental updates: a change log over a snapshot, merged when read, compacted into a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = ("is_dir", "size", "mtime", "content")


def latest(changes: DataFrame, order: Column | None = None) -> DataFrame:
    """The last change of every path: path, op, is_dir, size, mtime, content. A re-created path is live again."""
    at = F.col("seq") if order is None else order
    picked = F.max_by(F.struct("op", *META), at).alias("last")
    return changes.groupBy("path").agg(picked).select("path", "last.op", *[f"last.{c}" for c in META])


def live(last: DataFrame) -> DataFrame:
    return last.filter("op = 'upsert'").select("path", *META)


def suppress(cold: DataFrame, last: DataFrame, subtrees: bool = False) -> DataFrame:
    """cold without the paths that were changed at all; with subtrees, also without what lies under a deleted directory."""
    out = cold.join(last.select("path"), "path", "left_anti")
    if subtrees:
        gone = last.filter("op = 'delete'").select(F.concat("path", F.lit("/")).alias("above"))
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
        under = out.select("path", F.explode(above).alias("above")).join(gone, "above", "left_semi").select("path").distinct()
        out = out.join(under, "path", "left_anti")
    return out


def merged(cold: DataFrame, changes: DataFrame, order: Column | None = None, db: str | None = None, subtrees: bool = False) -> DataFrame:
    """What a reader sees: the cold rows that no change shadows, and the live rows of the overlay."""
    last = latest(changes, order)
    overlay = live(last)
    if "db" in cold.columns:
        overlay = overlay.withColumn("db", F.lit(db))
    return suppress(cold, last, subtrees).unionByName(overlay.select(*cold.columns))


def overlay_length(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count_distinct("path").alias("paths"))


def needs_compaction(changes: DataFrame, threshold: int = 2000) -> bool:
    return overlay_length(changes).first()["paths"] >= threshold
