"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

A record is ``WARC/1.0 CRLF headers CRLF CRLF block CRLF CRLF``. The text sink writes one record per row with the line
separator ``CRLF CRLF``, so the part files are plain, concatenated WARC archives.

Reading splits the archives at every occurrence of the magic line, in splits that any task can read. Each segment that
parses as a record header is a candidate; its declared lengths name the offset of its successor. Only candidates that
the chain of successors reaches from the start of the file are records: a magic line inside a payload starts a segment
too, but no chain leads there.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import materialise, scratch_path

MAGIC = "WARC/1.0\r\n"
CRLF = "\r\n"
#: An archive holds so many records at most. Up to CANDIDATES of its candidates, some 100 bytes each, are verified by
#: one task; of archives with more (payloads can hold any number of record headers), by joins over all tasks.
RECORDS_PER_FILE, CANDIDATES = 20_000, 200_000
#: Bytes of an archive that are matched with the records over them at a time.
BUCKET = 65_536
#: Revisits up to this number are broadcast to the writer (some 60 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are 32 digits of 5 bits, taken 40 bits at a time."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest and refers_to (null where the row is a response)."""
    payload = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    firsts = (
        base.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 AND first_id IS NOT NULL")
        .select("payload_digest", "payload_bytes", "first_id")
    )
    firsts = materialise(firsts, "warc-firsts")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    joined = base.join(firsts, ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))


def record_text(rows: DataFrame) -> Column:
    """The record of a row, without the CRLF CRLF that ends it."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    # an address is one header line: white space and control characters in it are percent-encoded away
    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]+", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(CRLF + CRLF))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), address,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(http) + F.octet_length(body),
        F.lit(CRLF + CRLF), http, body,
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row of pages(page_id, url, html) under path; null html is an empty payload.

    Rows with equal payloads (SHA-1 and length) of min_bytes or more: the largest page_id is the response, others are
    revisits that keep its HTTP header without the body. Payloads are never cut.
    """
    rows = with_revisits(pages, min_bytes)
    rows.select(record_text(rows).alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


HEADER = re.compile(rb"((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n")
CANDIDATE = "file string, block bigint, start bigint, next bigint, whole boolean, page_id bigint, payload_bytes bigint, payload_digest string, declared_digest string, record_type string, refers_to bigint"
BLOCKS = "file string, block bigint, consumed bigint"


def _fields(head: bytes) -> dict[bytes, bytes]:
    lines = (x.partition(b":") for x in head.split(b"\r\n") if x)
    return {k.strip().lower(): v.strip() for k, _, v in lines}


def _number(urn: bytes) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", urn)
    return int(found[1]) if found else None


def parse_record(data: bytes) -> dict | None:
    """What a segment (after its magic line) says as a record; None if it is no record header.

    ``size``: bytes from after the magic line to the successor. ``whole``: the segment holds the record to its end.
    """
    head = HEADER.match(data)
    if not head:
        return None
    f = _fields(head[1])
    length = f.get(b"content-length", b"")
    if not length.isdigit() or f.get(b"warc-type") not in (b"response", b"revisit"):
        return None
    end = head.end() + int(length)
    out = {"size": end + 4, "whole": len(data) >= end and data[end : end + 4] in (b"\r\n\r\n", b""), "page_id": _number(f.get(b"warc-record-id", b"")), "record_type": f[b"warc-type"].decode(), "declared_digest": f.get(b"warc-payload-digest", b"sha1:")[5:].decode(), "refers_to": _number(f.get(b"warc-refers-to", b"")), "payload_bytes": None, "payload_digest": None}
    if out["whole"]:
        http, _, body = data[head.end() : end].partition(b"\r\n\r\n")
        stated = _fields(http).get(b"content-length", b"")
        if out["record_type"] == "response":
            out |= {"payload_bytes": len(body), "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode()}
        else:
            out |= {"payload_bytes": int(stated) if stated.isdigit() else None, "payload_digest": out["declared_digest"]}
    return out


def _columns(batch: pa.RecordBatch) -> tuple[list, list, list]:
    return batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with offsets from the start of their split; a last row per split tells how far it reached."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("next", pa.int64()), ("whole", pa.bool_()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    here, at = None, 0
    for batch in batches:
        rows = []
        for file, block, data in zip(*_columns(batch)):
            if (file, block) != here:
                if here:
                    rows.append({"file": here[0], "block": here[1], "next": at})
                here, at = (file, block), 0
            if found := parse_record(data):
                rows.append({"file": file, "block": block, "start": at, "next": at + found.pop("size") + len(MAGIC)} | found)
            at += len(data) + len(MAGIC)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    if here:
        yield pa.RecordBatch.from_pylist([{"file": here[0], "block": here[1], "next": at}], schema)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))


def reachable(start: np.ndarray, follows: np.ndarray, first: int) -> np.ndarray:
    """Which candidates the chain from offset ``first`` reaches, by pointer jumping in log2(n) rounds.

    start is sorted and without repeats; follows[i] is the offset that candidate i names as its successor.
    """
    n = len(start)
    to = np.searchsorted(start, follows)
    to = np.where((to < n) & (start[np.minimum(to, n - 1)] == follows), to, n) if n else to
    to = np.append(to, n)
    reach = np.zeros(n + 1, bool)
    reach[:n] = start == first
    for _ in range(max(1, n.bit_length() + 1)):
        reach[to[reach]] = True
        to = to[to]
    return reach[:n]


def reachable_by_joins(candidates: DataFrame) -> DataFrame:
    """(file, start) of the candidates that the chain from each file's start reaches, by pointer jumping over all tasks.

    Every round doubles how far the jumps reach and adds what they reach from all records found so far; a jump that
    leads to no candidate ends there. Rounds follow the logarithm of the longest chain.
    """
    steps = candidates.select("file", "start", "next")
    there = candidates.select("file", F.col("start").alias("next"))
    jumps = materialise(steps.join(there, ["file", "next"], "left_semi").select("file", "start", "next"), "warc-jumps")
    reached = materialise(candidates.filter(F.col("start") == len(MAGIC)).select("file", "start").distinct(), "warc-reached")
    while not jumps.isEmpty():
        ahead = reached.join(jumps, ["file", "start"]).select("file", F.col("next").alias("start"))
        reached = materialise(reached.unionByName(ahead).distinct(), "warc-reached")
        onward = jumps.select("file", F.col("start").alias("next"), F.col("next").alias("then"))
        jumps = materialise(jumps.join(onward, ["file", "next"]).select("file", "start", F.col("then").alias("next")), "warc-jumps")
    return reached


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("start", kind="stable").reset_index(drop=True)
    # the segment before the first magic line of a file is empty, so its chain starts behind that separator
    keep = reachable(pdf["start"].to_numpy(np.int64), pdf["next"].to_numpy(np.int64), len(MAGIC))
    return pdf[keep]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payload length and digest of a response come from the bytes read and are held against its header; a damaged
    payload raises. Those of a revisit come from the headers it keeps. Records whose payload holds the magic line are
    put together from their segments. No archives give an empty result.
    """
    found = materialise(_segments(spark, path).mapInArrow(_candidates, CANDIDATE), "warc-candidates")
    # a split starts where the splits before it ended
    ends = found.filter("start IS NULL").select("file", "block", F.col("next").alias("consumed"))
    before = F.sum("consumed").over(_before())
    bases = ends.select("file", "block", F.coalesce(before, F.lit(0)).cast("bigint").alias("base"))
    placed = found.filter("start IS NOT NULL").join(bases, ["file", "block"])
    placed = materialise(placed.withColumn("start", F.col("start") + F.col("base")).withColumn("next", F.col("next") + F.col("base")).drop("base"), "warc-placed")
    sizes = placed.groupBy("file").agg(F.count(F.lit(1)).alias("candidates"))
    crowded = sizes.filter(F.col("candidates") > CANDIDATES).select("file")
    records = placed.join(crowded, "file", "left_anti").groupBy("file").applyInPandas(_verify, placed.schema)
    if not crowded.isEmpty():
        many = placed.join(crowded, "file", "left_semi")
        records = records.unionByName(many.join(reachable_by_joins(many), ["file", "start"], "left_semi"))
    records = materialise(records, "warc-records")
    done = records.filter("whole")
    split = records.filter("NOT whole").select("file", F.col("start").alias("first"), F.col("next").alias("last"))
    if not split.isEmpty():
        done = done.unionByName(_joined(spark, path, split, bases).select(*done.columns))
    wrong = (F.col("record_type") == "response") & ~F.col("payload_digest").eqNullSafe(F.col("declared_digest"))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("damaged payload in "), F.col("file")))).otherwise(F.col("payload_digest"))
    return done.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, at = None, 0
    for batch in batches:
        starts, sizes = [], []
        for file, block, data in zip(*_columns(batch)):
            if (file, block) != here:
                here, at = (file, block), 0
            starts.append(at)
            at += len(data) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.int64()), batch.column(2)], ["file", "block", "at", "data"])


def _joined(spark: SparkSession, path: str, split: DataFrame, bases: DataFrame) -> DataFrame:
    """Records that span segments: their segments are grouped by record, so a task holds one record at a time.

    Segments meet the record over them by the bucket of bytes that they start in.
    """
    pieces = _segments(spark, path).mapInArrow(_offsets, "file string, block bigint, at bigint, data binary")
    pieces = pieces.join(bases, ["file", "block"]).withColumn("at", F.col("at") + F.col("base")).withColumn("bucket", F.floor(F.col("at") / BUCKET))
    over = split.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / BUCKET), F.floor((F.col("last") - 1) / BUCKET))))
    mine = pieces.join(over, ["file", "bucket"]).filter("at >= first AND at < last")

    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        data = MAGIC.encode().join(pdf["data"])
        size = int(pdf["last"].iloc[0] - pdf["first"].iloc[0])
        found = parse_record(data[: size - len(MAGIC)]) or {}
        row = {"file": pdf["file"].iloc[0], "block": 0, "start": int(pdf["first"].iloc[0]), "next": int(pdf["last"].iloc[0])}
        row |= {k: v for k, v in found.items() if k != "size"}
        return pd.DataFrame([row]).reindex(columns=[x.split()[0] for x in CANDIDATE.split(", ")])

    return mine.groupBy("file", "first").applyInPandas(put_together, CANDIDATE)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as WARC archives in the shared folder and return what reading them back says.

    Null html is an empty payload; a null page_id stays null; an empty table gives an empty result; other columns of
    pages are not written.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    return read_warc(spark, path)
