"""Line output: the lines, or blocks of lines, in which a match of the content begins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.patterns import java_regex, quote
from trawl.functions.text import ascii_fold, fold_needle, lines
from trawl.model import Case, Options, SearchRequest
from trawl.operators.filters import path_filter
from trawl.operators.search import content_predicate, select_db

MARK = "\x01"


def _match_regex(query: str, request: SearchRequest) -> str:
    sensitive = request.opts.case.sensitive(query)
    if request.opts.regex:
        return java_regex(query, sensitive)
    # without U, (?i) folds A-Z alone, as literal content search does
    return quote(query) if sensitive else "(?i)" + quote(fold_needle(query))


def _hit_lines(rows: DataFrame, request: SearchRequest) -> DataFrame:
    """rows with ``lines``, and ``hits``: (line_no, text) of the lines in which a match begins.

    A literal without a line feed lies in one line, so each line is looked at by itself. Otherwise all matches of the
    whole content get a mark in front, so anchors keep to the content's ends; marks that the content has itself are
    taken out before.
    """
    query, sensitive = request.query, request.opts.case.sensitive(request.query)
    split = rows.withColumn("lines", lines(F.col("content")))
    each = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("text")))
    if not request.opts.regex and "\n" not in query:
        if sensitive:
            return split.withColumn("hits", F.filter(each, lambda s: s["text"].contains(query)))
        return split.withColumn("hits", F.filter(each, lambda s: ascii_fold(s["text"]).contains(fold_needle(query))))
    plain = F.replace(F.col("content"), F.lit(MARK), F.lit(""))
    marked = lines(F.regexp_replace(plain, _match_regex(query, request), MARK + "$0"))
    # zipped, not looked up by number: an expression inside a lambda would be computed anew for every line
    pairs = F.zip_with("lines", marked, lambda x, m: F.struct(x.alias("text"), m.contains(MARK).alias("hit")))
    numbered = F.transform(pairs, lambda s, i: F.struct((i + 1).alias("line_no"), s["text"].alias("text"), s["hit"].alias("hit")))
    return split.withColumn("hits", F.filter(numbered, lambda s: s["hit"]))


def match_offsets(files: DataFrame, needle: str, sensitive: bool = False) -> DataFrame:
    """(db, path, byte_offset) of every occurrence of a literal in the contents, from the left and without overlaps.

    Offsets count bytes of UTF-8 from 0. Only contents that hold the literal leave the scan.
    """
    rows = files.filter(F.col("content").isNotNull() & content_predicate(needle, Options(case=Case.SENSITIVE if sensitive else Case.INSENSITIVE)))
    wanted = (needle if sensitive else fold_needle(needle)).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, offsets = [], []
            for k, data in enumerate(batch.column(2).to_pylist()):
                data = data if sensitive else data.lower()  # bytes.lower folds A-Z alone
                found = data.find(wanted)
                while found >= 0:
                    at.append(k)
                    offsets.append(found)
                    found = data.find(wanted, found + len(wanted))
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(offsets, pa.int64())], ["db", "path", "byte_offset"])

    return rows.select("db", "path", F.encode("content", "UTF-8").alias("data")).mapInArrow(run, "db string, path string, byte_offset bigint")


def search_lines(files: DataFrame, request: SearchRequest, context: int | None = None) -> DataFrame:
    """Line hits: db, path, line_no (from 1), text. With context, blocks of up to that many lines on either side.

    Path filters and scope hold; a limit counts hits, in order of path and line. Of blocks that start at the same line,
    the first match's stays. Lines are split only in contents that match.
    """
    rows = select_db(files, request.db).filter(path_filter(request.opts, request.scope))
    rows = rows.filter(F.col("content").isNotNull() & content_predicate(request.query, request.opts))
    rows = _hit_lines(rows, request)
    if context is None:
        # outer, for a plain explode adds a filter that computes the hits a second time
        out = rows.select("db", "path", F.explode_outer("hits").alias("hit")).filter("hit IS NOT NULL").select("db", "path", "hit.line_no", "hit.text")
    else:
        rows = rows.filter(F.size("hits") > 0)
        numbers = F.transform("hits", lambda h: h["line_no"])
        firsts = F.array_distinct(F.transform(numbers, lambda n: F.greatest(F.lit(1), n - context)))
        blocks = rows.select("db", "path", "lines", F.col("content").endswith("\n").alias("closed"), F.array_min(numbers).alias("earliest"), F.explode(firsts).alias("line_no"))
        match = F.when(F.col("line_no") > 1, F.col("line_no") + context).otherwise(F.col("earliest"))
        last = F.least(F.size("lines"), match + context)
        text = F.array_join(F.slice("lines", F.col("line_no"), last - F.col("line_no") + 1), "\n")
        out = blocks.select("db", "path", "line_no", F.concat(text, F.when((last < F.size("lines")) | F.col("closed"), "\n").otherwise("")).alias("text"))
    return out if request.cap is None else out.orderBy("path", "line_no", "db").limit(request.cap)


def render(hits: DataFrame, context: bool = False) -> DataFrame:
    """Rows (path, line_no, rendered): ``path:line:text``, or ``path-line:text`` for every line of a block."""
    if not context:
        return hits.select("path", "line_no", F.concat_ws(":", "path", F.col("line_no").cast("string"), "text").alias("rendered"))
    body = F.regexp_replace("text", r"\n+\z", "")
    each = hits.select("path", F.col("line_no").alias("first"), F.posexplode(F.split(body, "\n", -1)).alias("at", "line"))
    number = F.col("first") + F.col("at")
    return each.select("path", number.alias("line_no"), F.concat(F.col("path"), F.lit("-"), number.cast("string"), F.lit(":"), F.col("line")).alias("rendered"))
