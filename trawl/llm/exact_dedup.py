"""Exact deduplication by a 128-bit content hash with byte comparison inside its groups."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import byte_view

COLUMNS = "doc_id bigint, h128 binary, text_sha256 string"


def _hashed(with_text: bool, digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_view(batch.column(1))
            data = data.lower()  # bytes.lower changes A-Z alone
            view, ends = memoryview(data), at.tolist()
            spans = [view[i:j] for i, j in zip(ends, ends[1:])]
            out = [
                batch.column(0).cast(pa.int64()),
                pa.array([digest(s) for s in spans], pa.binary()),
                pa.array([hashlib.sha256(s).hexdigest() for s in spans], pa.string()),
            ]
            names = ["doc_id", "h128", "text_sha256"]
            if with_text:
                out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(spans), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)]).cast(pa.binary()))
                names.append("norm")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays (``kept``). The texts are grouped by (128-bit hash, bytes): Spark compares the bytes of group
    keys, so a collision of ``digest`` makes two groups. Every task folds its copies to one row before the shuffle, so a
    group of any size moves a row per task; the members meet their group by the 128-bit hash and the SHA-256 of the
    bytes, in a join that adaptive execution can split.

    Null ids: never kept, and keep_id is null where a whole group has none. Rows that repeat both id and text are one
    document and share its verdict. An empty table gives an empty result; other columns of docs are not looked at.
    """
    pair = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    groups = (
        pair.mapInArrow(_hashed(True, digest), COLUMNS + ", norm binary")
        .groupBy("h128", "text_sha256", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h128", "text_sha256", "keep_id", "group_size")
    )
    members = pair.mapInArrow(_hashed(False, digest), COLUMNS)
    return members.join(groups, ["h128", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents) AS d
WINDOW w AS (PARTITION BY norm)
"""
