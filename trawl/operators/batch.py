"""Many filename queries in one pass over the paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import ascii_fold
from trawl.model import Case

#: Paths whose runs of characters tell which of a query's is rarest; only speed depends on it.
SAMPLE = 2000
#: Characters of the runs that queries and paths meet by.
RUN = 3


def _runs(text: Column, length: int) -> Column:
    """The distinct runs of so many characters."""
    last = F.length(text) - length + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(length))))).otherwise(F.array().cast("array<string>"))


def search_batch(files: DataFrame, queries: list[str], case: Case = Case.SMART) -> DataFrame:
    """(query, path) of every literal query and the paths that contain it, as single searches would find them.

    A query and a path meet by a run of characters that the query holds and the path too: of each query, the one that
    is rarest in a few paths. So a path is compared with the queries that share a rare run with it, not with all; any
    number of queries will do. Empty queries find nothing.
    """
    spark = files.sparkSession
    wanted = [(q, case.sensitive(q)) for q in dict.fromkeys(queries) if q]
    # with regard to case, runs are those of the path with A-Z folded; without, of the path in lower case
    folded = {True: ascii_fold(F.col("path")), False: F.lower("path")}
    seen: dict[str, int] = {}
    for r in files.select("path").limit(SAMPLE).collect():
        for low in {r["path"].lower()}:
            for n in (1, 2, RUN):
                for x in {low[i : i + n] for i in range(len(low) - n + 1)}:
                    seen[x] = seen.get(x, 0) + 1
    rows = []
    for query, sensitive in wanted:
        needle = query if sensitive else query.lower()
        low = fold_ascii(query) if sensitive else needle
        n = min(RUN, len(low))
        rows.append((query, needle, sensitive, n, min((low[i : i + n] for i in range(len(low) - n + 1)), key=lambda x: (seen.get(x, 0), x))))
    needles = spark.createDataFrame(rows, "query string, needle string, sensitive boolean, n int, run string")
    found = None
    for sensitive in {s for _, s in wanted}:
        sizes = sorted({r[3] for r in rows if r[2] == sensitive})
        met = files.select("path", folded[sensitive].alias("low")).select("path", "low", F.explode(F.concat(*[_runs(F.col("low"), n) for n in sizes])).alias("run"))
        pairs = met.join(needles.filter(F.col("sensitive") == sensitive), "run")
        hits = pairs.filter(F.contains(F.col("path") if sensitive else F.col("low"), F.col("needle"))).select("query", "path")
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], "query string, path string")


def fold_ascii(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)
