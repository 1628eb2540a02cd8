"""Search over filename and content layers: match, merge by path, filter, sort, limit.

One scan decides both layers' flags for every row; only the hits, without their content, are shuffled by path.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.display import kind_weight
from trawl.functions.patterns import java_regex
from trawl.functions.text import ascii_fold, basename, depth, fold_needle, required_literal
from trawl.model import Layers, Options, PathMode, SearchRequest, Sort
from trawl.operators import overlay
from trawl.operators.filters import path_filter
from trawl.operators.index import ContentIndex
from trawl.plans import boolquery, findexpr

#: What results say of a file.
META = ("path", "is_dir", "size", "mtime")
#: Characters of a regular expression's literal from which on it is worth a look of its own.
ATOM = 3


def _regex(subject: Column, pattern: str, sensitive: bool) -> Column:
    """Whether the pattern is found; a literal that every match holds is looked for first."""
    found = subject.rlike(java_regex(pattern, sensitive))
    atom = required_literal(pattern, sensitive)
    if not atom or len(atom) < ATOM:
        return found
    return (subject if sensitive else ascii_fold(subject)).contains(atom) & found


def name_predicate(query: str, opts: Options) -> Column:
    """Whether a path matches: regular expression, or boolean query of substrings; malformed ones are one substring."""
    if not query:
        return F.lit(False)
    sensitive = opts.case.sensitive(query)
    path = basename(F.col("path")) if opts.path_mode == PathMode.BASENAME else F.col("path")
    if opts.regex:
        return _regex(path, query, sensitive)

    def term(word: str) -> Column:
        return path.contains(word) if sensitive else F.lower(path).contains(word.lower())

    tree = None if opts.raw else boolquery.parse(query)
    return term(query) if tree is None else tree.column(term)


def content_predicate(query: str, opts: Options) -> Column:
    """Whether a content matches: the whole query is one substring unless boolean_content is set.

    Case-insensitive search folds A-Z of the content only, and the needle fully; so it finds other capitals in lower
    case alone.
    """
    if not query:
        return F.lit(False)
    sensitive, content = opts.case.sensitive(query), F.col("content")
    if opts.regex:
        return _regex(content, query, sensitive)

    def term(word: str) -> Column:
        return content.contains(word) if sensitive else ascii_fold(content).contains(fold_needle(word))

    tree = boolquery.parse(query) if opts.boolean_content else None
    return term(query) if tree is None else tree.column(term)


def select_db(files: DataFrame, db: str | None) -> DataFrame:
    """The rows of one database; an unknown name raises and lists the names there are."""
    if db is None:
        return files
    mine = files.filter(F.col("db") == db)
    if mine.select("db").limit(1).isEmpty():
        names = sorted(r["db"] for r in files.select("db").distinct().limit(1000).collect() if r["db"] is not None)
        raise ValueError(f"no database {db!r}; there are: {', '.join(names)}")
    return mine


def kind_of(by_name: Column, by_content: Column) -> Column:
    return F.when(by_name & by_content, "both").when(by_content, "content").otherwise("filename")


def merge_hits(flagged: DataFrame) -> DataFrame:
    """Rows (db, path, is_dir, size, mtime, by_name, by_content) merged by path: the first database's metadata, and the kind.

    What the first file lacks is taken from the next one; of one database's files those come first that lack nothing.
    """
    order = F.struct("db", F.col("size").isNull(), F.col("mtime").isNull(), "size", "mtime", "is_dir")
    meta = [F.min_by(name, F.when(F.col(name).isNotNull(), order)).alias(name) for name in META[1:]]
    merged = flagged.groupBy("path").agg(*meta, F.max("by_name").alias("by_name"), F.max("by_content").alias("by_content"))
    return merged.select(*META, kind_of(F.col("by_name"), F.col("by_content")).alias("kind"))


def reference_times(files: DataFrame, names: set[str]) -> dict[str, int]:
    if not names:
        return {}
    found = files.filter(F.col("path").isin(sorted(names))).groupBy("path").agg(F.max("mtime").alias("mtime"))
    return {r["path"]: r["mtime"] for r in found.collect()}  # a row for each name in the expression at most


def order_columns(sort: Sort) -> list[Column]:
    if sort == Sort.NONE:
        return []
    path = F.col("path").asc()
    if sort == Sort.PATH:
        return [path]
    kind = kind_weight(F.col("kind")).asc()
    return [kind, path] if sort == Sort.KIND else [kind, depth(F.col("path")).asc(), path]


def flagged(files: DataFrame, request: SearchRequest) -> DataFrame:
    """The rows that either layer takes: db, path, is_dir, size, mtime, by_name, by_content."""
    opts, no = request.opts, F.lit(False)
    by_name = F.coalesce(name_predicate(request.query, opts), no) if opts.layers != Layers.CONTENT else no
    by_content = F.coalesce(content_predicate(request.query, opts), no) if opts.layers != Layers.FILENAME else no
    rows = files.filter(path_filter(opts, request.scope))
    return rows.select("db", *META, by_name.alias("by_name"), by_content.alias("by_content")).filter("by_name OR by_content")


def judged(hits: DataFrame, files: DataFrame, request: SearchRequest, unique: bool = False) -> DataFrame:
    """Flagged rows merged by path, and what the find expression leaves of them; files give its reference times."""
    kind = kind_of(F.col("by_name"), F.col("by_content"))
    merged = hits.select(*META, kind.alias("kind")) if unique else merge_hits(hits)
    if request.opts.expr:
        tree = findexpr.parse(request.opts.expr)
        merged = merged.filter(findexpr.column(tree, reference_times(files, findexpr.references(tree)), request.opts.byte_glob))
    return merged


def matches(files: DataFrame, request: SearchRequest, unique: bool = False) -> DataFrame:
    """All results, neither sorted nor limited: path, is_dir, size, mtime, kind.

    ``unique``: the caller knows that no path comes twice in files, as in any one database; then nothing is shuffled.
    """
    return judged(flagged(select_db(files, request.db), request), files, request, unique)


def uses_index(request: SearchRequest) -> bool:
    """Whether the content layer of the request is one literal of three bytes or more."""
    opts = request.opts
    plain = not opts.regex and (not opts.boolean_content or boolquery.parse(request.query) is None)
    return opts.layers != Layers.FILENAME and plain and len(fold_needle(request.query).encode()) >= 3


def indexed_flags(index: ContentIndex, request: SearchRequest) -> DataFrame:
    """``flagged`` over the files of a written index: paths are scanned without contents, contents through the index.

    A path that both layers take has a row of each.
    """
    files, opts = index.docs.drop("doc"), request.opts
    if not uses_index(request):
        return flagged(files, request)
    held = index.holding(request.query, opts.case.sensitive(request.query)).filter(path_filter(opts, request.scope))
    hits = held.select("db", *META, F.lit(False).alias("by_name"), F.lit(True).alias("by_content"))
    if opts.layers == Layers.BOTH:
        hits = hits.unionByName(flagged(files, replace(request, opts=replace(opts, layers=Layers.FILENAME))))
    return hits


@dataclass(frozen=True)
class Indexed:
    """A database as searches see it: a written index, and the changes since (as an overlay's), if there are any."""

    db: str
    index: ContentIndex
    changes: DataFrame | None = None

    def files(self) -> DataFrame:
        cold = self.index.docs.drop("doc")
        return cold if self.changes is None else overlay.merged(cold, self.changes, db=self.db)

    def flags(self, request: SearchRequest) -> DataFrame:
        """The cold hits that no change shadows, and those among the changed files, which are scanned."""
        hits = indexed_flags(self.index, request)
        if self.changes is None:
            return hits
        last = overlay.latest(self.changes)
        fresh = overlay.live(last).select(F.lit(self.db).alias("db"), "path", *overlay.META)
        return overlay.suppress(hits, last).unionByName(flagged(fresh, request))


def indexed_matches(databases: list[Indexed], request: SearchRequest) -> DataFrame:
    """``matches`` over several databases, each through its index."""
    files = reduce(DataFrame.unionByName, [d.files() for d in databases])
    select_db(files, request.db)  # an unknown name raises
    hits = reduce(DataFrame.unionByName, [d.flags(request) for d in databases])
    return judged(hits if request.db is None else hits.filter(F.col("db") == request.db), files, request)


def indexed_search(databases: list[Indexed], request: SearchRequest) -> DataFrame:
    """``search`` over several databases, each through its index."""
    return ordered(indexed_matches(databases, request), request)


def ordered(out: DataFrame, request: SearchRequest) -> DataFrame:
    if columns := order_columns(request.opts.sort):
        out = out.orderBy(*columns)
    return out if request.cap is None else out.limit(request.cap)


def search(files: DataFrame, request: SearchRequest, unique: bool = False) -> DataFrame:
    """Results of a request over files(db, path, is_dir, size, mtime, content): filtered, then sorted, then limited."""
    return ordered(matches(files, request, unique), request)


def count_results(files: DataFrame, request: SearchRequest) -> DataFrame:
    return search(files, request).agg(F.count(F.lit(1)).alias("total"))
