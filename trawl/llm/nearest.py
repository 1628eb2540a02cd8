"""Approximate nearest neighbours by inner product: balanced posting lists behind an in-memory centroid graph.

Inner-product search becomes Euclidean search by one more dimension: a vector v of norm at most M gets
sqrt(M^2 - |v|^2), a query 0. Centroids start as the leaves of a balanced bisection of a bounded sample and are then
moved and weighted until their lists are about equally long: a vector belongs to the list with the least weighted
distance. A boundary vector stands in other lists nearly as near as well. A query, scaled to norm M, finds its nearest
centroids by a best-first walk in a neighbour graph over the centroids, and reads those lists whose distance is within
a ratio of the nearest one's, and as many more as hold enough candidates. The ratio is the table's own: the least that
finds RECALL of the exact neighbours of a bounded sample of queries.

Lists are dealt to a fixed number of cells and the queries of a cell to blocks; a task holds a block of queries and
streams the cell's vectors past it, so its memory is bounded and a query gets k rows from each cell at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.common import hash_sample, materialise

K = 20
#: Vectors sampled for the centroids at most; vectors of the sample for a centroid.
SAMPLE, PER_CENTROID = 32_768, 32
#: Rounds that even out the lists, and the most weight of a list, as a share of the usual squared distance.
ROUNDS, HANDICAP = 9, 0.15
#: A boundary vector: centroids within (1 + REPLICA) times the nearest distance, REPLICAS lists at most.
REPLICA, REPLICAS = 0.01, 3
#: A query reads lists within (1 + ratio) times the nearest distance: a ratio of PRUNE, or more where the exact
#: neighbours of PROBES queries at most show that it takes more to find RECALL of them.
PRUNE, RECALL, PROBES = 0.05, 0.95, 256
DEGREE, BEAM = 24, 64
#: Queries whose lists a task finds, about.
WALK = 1024
#: Cells of about equally many vectors, and queries of a block at most.
CELLS, BLOCK = 16, 16_384
#: Partitions of the search at most, and scored pairs that a task holds before it folds them.
TASKS, HELD = 10_000, 1_000_000


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists without nulls as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def lists_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive runs of values, counts[i] long each, as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that take part, with their length, largest component and a hash of their components."""
    names = ["vec_id", "embedding", "width", "top", "key"]
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        # a null list may hide values, and flatten() leaves them out: lengths of null lists count as 0
        sizes = np.where(vectors.is_null().to_numpy(zero_copy_only=False), 0, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = vectors.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) + 0.0  # nulls as NaN, -0 as 0
        at = np.concatenate([[0], np.cumsum(sizes)])
        good, top = np.isfinite(values), np.where(np.isfinite(values), np.abs(values), 0)
        bad = np.concatenate([[0], np.cumsum(~good)])
        full = sizes > 0
        tops = np.zeros(len(sizes))
        tops[full] = np.maximum.reduceat(top, at[:-1][full]) if full.any() else 0
        keep = full & (bad[at[1:]] == bad[at[:-1]]) & (tops > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
        rows = np.nonzero(keep)[0]
        own = [values[at[i] : at[i + 1]] for i in rows]
        data = np.concatenate(own) if own else np.zeros(0)
        out = [ids.take(pa.array(rows)), lists_column(data, sizes[rows], vectors.type.value_type), pa.array(sizes[rows], pa.int32()), pa.array(tops[rows]), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary())]
        yield pa.RecordBatch.from_arrays(out, names)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, width, top and key of the rows that take part: no null, NaN or infinite component, not zero."""
    kind = vectors.schema["embedding"].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    given = F.col("embedding") if plain else F.col("embedding").cast("array<double>")
    element = kind.elementType.simpleString() if plain else "double"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), given.alias("embedding"))
    return rows.mapInArrow(_clean, f"vec_id bigint, embedding array<{element}>, width int, top double, key binary")


# -- centroids


def _leaves(points: np.ndarray, count: int) -> np.ndarray:
    """Means of the leaves of a balanced bisection, neighbours side by side: a node is cut along the line between two far points."""

    def cut(group: np.ndarray, n: int) -> list[np.ndarray]:
        if n < 2 or len(group) < 2:
            return [group]
        own = points[group]
        a = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
        b = own[((own - a) ** 2).sum(1).argmax()]
        middle = len(group) * (n // 2) // n
        for _ in range(4):
            order = np.argsort(own @ (b - a), kind="stable")
            a, b = own[order[:middle]].mean(0), own[order[middle:]].mean(0)
        return cut(group[order[:middle]], n // 2) + cut(group[order[middle:]], n - n // 2)

    return np.stack([points[g].mean(0) for g in cut(np.arange(len(points)), max(1, min(count, len(points))))])


def balanced_centroids(points: np.ndarray, count: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, weights): with the weights added to squared distances, lists of the points are about equally long.

    A third of the rounds moves centroids to the means of their lists. In the others a list that is too long gets as
    much more weight as makes it give up half its excess, HANDICAP of the usual squared distance in all at most.
    """
    centroids = _leaves(points, count)
    n = len(centroids)
    weights, goal = np.zeros(n), len(points) / n
    for step in range(rounds):
        ids, far = _nearest(points, centroids, weights, 2)
        mine = ids[:, 0]
        sizes = np.bincount(mine, minlength=n)
        if step < rounds // 3:
            sums = np.stack([np.bincount(mine, points[:, d], n) for d in range(points.shape[1])], 1)
            centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        elif n > 1:
            gap = far[:, 1] + weights[ids[:, 1]] - far[:, 0] - weights[mine]
            order = np.lexsort((gap, mine))
            excess = np.maximum(sizes - goal, 0) / 2
            at = np.cumsum(sizes) - sizes + excess.astype(np.int64)
            more = np.where(excess >= 1, gap[order[np.minimum(at, len(points) - 1)]], 0)
            weights = np.minimum(weights + more, HANDICAP * float(np.median(far[:, 0])))
    return centroids, weights


def _nearest(points: np.ndarray, centroids: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(lists, squared distances without weights) of the ``most`` lists of least weighted distance, least first."""
    most = min(most, len(centroids))
    found, far = np.empty((len(points), most), np.int64), np.empty((len(points), most))
    squares = (centroids**2).sum(1)
    for k in range(0, len(points), 2048):
        some = points[k : k + 2048]
        apart = squares - 2 * some @ centroids.T
        near = apart + weights
        ids = near.argmin(1)[:, None] if most == 1 else np.argpartition(near, most - 1, axis=1)[:, :most]
        ids = np.take_along_axis(ids, np.argsort(np.take_along_axis(near, ids, 1), axis=1, kind="stable"), 1)
        found[k : k + 2048] = ids
        far[k : k + 2048] = np.maximum(np.take_along_axis(apart, ids, 1) + (some**2).sum(1)[:, None], 0)
    return found, far


class CentroidGraph:
    """Centroids with links to their DEGREE nearest and a ring over all, so that every centroid can be reached."""

    def __init__(self, centroids: np.ndarray, weights: np.ndarray | None = None):
        self.centroids, n = centroids.astype(np.float64), len(centroids)
        self.weights = np.zeros(n) if weights is None else weights
        self.squares = (self.centroids**2).sum(1)
        apart = self.squares[:, None] - 2 * self.centroids @ self.centroids.T + self.squares
        np.fill_diagonal(apart, np.inf)
        near = np.argsort(apart, axis=1, kind="stable")[:, : min(DEGREE, max(n - 1, 1))]
        self.links = np.concatenate([near, ((np.arange(n) + 1) % n)[:, None], ((np.arange(n) * 7 + 3) % n)[:, None]], 1)

    def search(self, points: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the nearest centroids found, nearest first; all points walk at once."""
        n, count = len(self.centroids), len(points)
        beam = min(beam, n)
        expand = min(n, max(8, beam // 8))
        rows, norms = np.arange(count)[:, None], (points**2).sum(1)[:, None]

        def distance(ids: np.ndarray) -> np.ndarray:
            return np.maximum(norms + self.squares[ids] - 2 * np.einsum("qd,qed->qe", points, self.centroids[ids]), 0)

        starts = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))
        seen, open_ = np.zeros((count, n), bool), np.full((count, n), np.inf)
        far = np.full((count, n), np.inf)  # distances of the centroids seen
        first = np.broadcast_to(starts, (count, len(starts)))
        far[rows, first] = open_[rows, first] = distance(first)
        seen[rows, first] = True
        for _ in range(n):
            take = np.argpartition(open_, expand - 1, axis=1)[:, :expand]
            worst = np.partition(far, beam - 1, axis=1)[:, beam - 1][:, None]
            live = np.isfinite(open_[rows, take]) & (open_[rows, take] <= worst)
            if not live.any():
                break
            open_[rows, take] = np.inf
            ahead = self.links[take].reshape(count, -1)
            fresh = np.repeat(live, self.links.shape[1], axis=1) & ~seen[rows, ahead]
            q, at = np.nonzero(fresh)
            key = np.unique(q * n + ahead[q, at])
            q, ids = key // n, key % n
            d = np.maximum(norms[q, 0] + self.squares[ids] - 2 * np.einsum("ij,ij->i", points[q], self.centroids[ids]), 0)
            far[q, ids] = open_[q, ids] = d
            seen[q, ids] = True
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(far, order, 1)


def ratios(points: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Distances over the nearest one (first in its row; at least a thousandth of the point's norm), less 1."""
    nearest = np.maximum(np.sqrt(squares[:, :1]), 1e-3 * np.sqrt((points**2).sum(1))[:, None])
    return np.sqrt(squares) / np.maximum(nearest, 1e-300) - 1


def lists_of(graph: CentroidGraph, points: np.ndarray, ratio: float, most: int, held: np.ndarray | None = None, need: int = 0, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs, rows in order: the lists that a query reads.

    They are those within (1 + ratio) times the nearest distance, and the nearest ones until they hold ``need`` vectors
    together (held: vectors of each list, each counted once); ``most`` at most. A beam that may have left out some is
    widened.
    """
    rows, found = [], []
    for k in range(0, len(points), 256):
        left, width = np.arange(k, min(k + 256, len(points))), beam
        while len(left):
            ids, d = graph.search(points[left], width)
            keep = ratios(points[left], d) <= ratio
            if held is not None:
                mine = held[ids]
                keep |= np.cumsum(mine, axis=1) - mine < need
            again = keep[:, -1] & (width < min(most, len(graph.centroids)))
            keep[:, most:] = False
            keep[:, 0] = True
            q, at = np.nonzero(keep & ~again[:, None])
            rows.append(left[q])
            found.append(ids[q, at])
            left, width = left[again], 2 * width
    rows, found = (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((found, rows))
    return rows[order], found[order]


class Space:
    """What turns vectors into points: a scale that keeps squares finite, and the radius of all vectors under it."""

    def __init__(self, top: float):
        self.scale, self.radius = 2.0 ** -np.ceil(np.log2(top)), 0.0

    def vectors(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale
        return np.concatenate([x, np.sqrt(np.maximum(self.radius**2 - (x**2).sum(1), 0))[:, None]], 1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Queries are brought to norm ``radius``, which leaves each one's neighbours as they are."""
        x = x * (1.0 / np.abs(x).max(1, keepdims=True))
        return np.concatenate([x * (self.radius / np.sqrt((x**2).sum(1)))[:, None], np.zeros((len(x), 1))], 1)


def _squares(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0)) * scale
                yield pa.RecordBatch.from_arrays([pa.array([float((x**2).sum(1).max())])], ["square"])

    return run


def _train(space: Space):
    """Centroids and weights of a sample that one task reads: SAMPLE vectors at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [matrix(b.column(0)) for b in batches if b.num_rows]
        if not parts:
            return
        x = np.unique(np.concatenate(parts), axis=0)
        centroids, weights = balanced_centroids(space.vectors(x), len(x) // PER_CENTROID)
        yield pa.RecordBatch.from_arrays([lists_column(centroids.ravel(), np.full(len(centroids), centroids.shape[1]), pa.float64()), pa.array(weights)], ["centroid", "weight"])

    return run


def _post(graph: CentroidGraph, space: Space):
    """Every vector with the lists that it stands in, its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, squares = _nearest(space.vectors(matrix(batch.column(1))), graph.centroids, graph.weights, REPLICAS)
            far = np.sqrt(squares)
            keep = far <= far.min(1, keepdims=True) * (1 + REPLICA)
            keep[:, 0] = True
            lists = lists_column(ids[keep], keep.sum(1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "embedding", "lists"])

    return run


# -- the pruning ratio


def _exact(probes: np.ndarray, ids: np.ndarray, most: int):
    """The ``most`` best vectors of all that a task reads, for each probe: probe, vec_id, score, lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names, scores, lists = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.list_(pa.int32()))
        least = np.full(len(probes), -np.inf)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(own):
                continue
            score = probes @ matrix(batch.column(1)).T
            score[ids[:, None] == own] = -np.inf
            if score.shape[1] > most:
                least = np.maximum(least, np.partition(score, -most, axis=1)[:, -most])
            row, col = np.nonzero((score >= least[:, None]) & np.isfinite(score))
            lists = pa.concat_arrays([lists, batch.column(2).take(pa.array(col))])
            rows, names, scores = np.concatenate([rows, row]), np.concatenate([names, own[col]]), np.concatenate([scores, score[row, col]])
            order = np.lexsort((names, -scores, rows))
            rank = _rank(rows[order])
            order = order[rank < most]
            rows, names, scores, lists = rows[order], names[order], scores[order], lists.take(pa.array(order))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(names), pa.array(scores), lists], ["probe", "vec_id", "score", "lists"])

    return run


def _rank(groups: np.ndarray) -> np.ndarray:
    """Place of each item in its run of equal groups."""
    if not len(groups):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[True], groups[1:] != groups[:-1]])
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(starts, at, 0))


def measured_ratio(graph: CentroidGraph, queries: DataFrame, posted: DataFrame, space: Space, k: int, repeats: int) -> tuple[float, int]:
    """(ratio, beam): the least ratio, PRUNE at least, at which a sample of the queries finds RECALL of its k exact
    neighbours, and how many lists most of them read then.

    The sample is scored against every vector; PROBES * k entries (times ``repeats`` of an id) reach the driver at most.
    """
    sample = hash_sample(queries, "vec_id", PROBES, queries.count(), 5).collect()
    if not sample:
        return PRUNE, BEAM
    probes, ids = np.array([r["embedding"] for r in sample], float), np.array([r["vec_id"] for r in sample])
    most = k * repeats
    scored = posted.mapInArrow(_exact(probes, ids, most), "probe bigint, vec_id bigint, score double, lists array<int>")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    entries = scored.withColumn("rank", rank).filter(F.col("rank") <= most).orderBy("probe", "rank").collect()
    points = space.queries(probes)
    near, far = graph.search(points, len(graph.centroids))
    apart = np.empty((len(probes), len(graph.centroids)))  # ratio at which the probe reads the list
    np.put_along_axis(apart, near, ratios(points, far), 1)
    apart[np.arange(len(probes)), near[:, 0]] = 0
    needed: list[dict] = [{} for _ in probes]
    for e in entries:
        mine = needed[e["probe"]]
        if e["vec_id"] in mine or len(mine) < k:
            mine[e["vec_id"]] = min(mine.get(e["vec_id"], np.inf), apart[e["probe"], e["lists"]].min())
    least = np.array([r for mine in needed for r in mine.values()])
    if not len(least):
        return PRUNE, BEAM
    # a hair above the entry that must be read, so that rounding leaves it in
    ratio = max(PRUNE, float(np.quantile(least, RECALL, method="higher")) * (1 + 1e-9))
    return ratio, int(np.quantile((apart <= ratio).sum(1), 0.9)) + 1


# -- the search


def cells_of(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, number of cells) of every list: short neighbouring lists share a cell, long ones fill several."""
    first, count, cell, held = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0, 0
    for name, n in enumerate(sizes.tolist()):
        if not n:
            continue
        if held and held + n > most:
            cell, held = cell + 1, 0
        first[name], count[name] = cell, -(-n // most)
        cell, held = (cell + count[name], 0) if n > most else (cell, held + n)
    return first, count


def _ask(graph: CentroidGraph, ratio: float, space: Space, cells: tuple[np.ndarray, np.ndarray], held: np.ndarray, need: int, beam: int):
    """A row for every query and cell that it reads, with the lists it reads there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count = cells
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, lists = lists_of(graph, space.queries(matrix(batch.column(1))), ratio, len(graph.centroids), held, need, beam)
            times = count[lists]  # a list without vectors has no cell
            rows, names = np.repeat(rows, times), np.repeat(lists, times)
            cell = first[names] + np.arange(len(names)) - np.repeat(np.cumsum(times) - times, times)
            yield _by_cell(batch, rows, names, cell)

    return run


def _by_cell(batch: pa.RecordBatch, rows: np.ndarray, lists: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    """The batch's ids and vectors once for each of their cells, with their lists there."""
    order = np.lexsort((lists, cell, rows))
    rows, lists, cell = rows[order], lists[order], cell[order]
    starts = np.nonzero(_starts(rows, cell))[0]
    at = pa.array(rows[starts])
    folded = lists_column(lists, np.diff(np.append(starts, len(rows))), pa.int32())
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), folded, pa.array(cell[starts], pa.int32())], ["id", "embedding", "lists", "cell"])


def _deal(cells: tuple[np.ndarray, np.ndarray]):
    """A row for every vector and cell that it stands in; a list of several cells is dealt by the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count = cells
        for batch in batches:
            rows, lists = _unfold(batch.column(2))
            mixed = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            yield _by_cell(batch, rows, lists, first[lists] + (mixed[rows] % count[lists].astype(np.uint64)).astype(np.int64))

    return run


SCORED = "query_id bigint, vec_id bigint, score double"


def _unfold(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every member of a list column."""
    counts = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(counts)), counts), column.flatten().to_numpy(zero_copy_only=False)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    return np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])


class _Search:
    """A block of queries, and the k best of the vectors shown to it so far.

    Single precision selects, with a bound on its rounding as slack; powers of two keep it in range. What is selected
    is scored in double precision on the vectors given.
    """

    def __init__(self, k: int, repeats: int, space: Space, ids: np.ndarray, queries: np.ndarray, row: np.ndarray, lists: np.ndarray):
        self.k, self.repeats, self.enough, self.space, self.ids, self.queries = k, repeats, (k + 1) * repeats, space, ids, queries
        order = np.argsort(lists, kind="stable")
        self.row, self.lists = row[order], lists[order]
        self.power = 2.0 ** -np.ceil(np.log2(np.abs(queries).max(1)))
        self.asks = (queries * self.power[:, None]).astype(np.float32)
        self.slack = (queries.shape[1] + 8) * 2.0**-22 * np.sqrt((self.asks.astype(np.float64) ** 2).sum(1)) * space.radius
        self.least = np.full(len(ids), -np.inf)
        self.q, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def show(self, ids: np.ndarray, vectors: np.ndarray, row: np.ndarray, lists: np.ndarray) -> None:
        small = (vectors * self.space.scale).astype(np.float32)
        order = np.argsort(lists, kind="stable")
        row, lists = row[order], lists[order]
        several = len(row) > len(ids)
        held, size, limit = [], 0, min(HELD, 4 * self.k * len(self.ids))  # bounds grow with every fold
        for name in np.unique(lists):
            qs = self.row[np.searchsorted(self.lists, name) : np.searchsorted(self.lists, name, "right")]
            vs = row[np.searchsorted(lists, name) : np.searchsorted(lists, name, "right")]
            for a in range(0, len(qs), 2048):
                some = qs[a : a + 2048]
                for b in range(0, len(vs), 2048):
                    part = vs[b : b + 2048]
                    near = self.asks[some] @ small[part].T
                    bound = self.least[some]
                    if len(part) > self.enough and not np.isfinite(bound).all():  # so many hold k ids other than the query's
                        self.least[some] = bound = np.maximum(bound, np.partition(near, -self.enough, axis=1)[:, -self.enough] - self.slack[some])
                    i, j = np.nonzero(near >= bound[:, None])
                    held.append((some[i], part[j]))
                    size += len(i)
                    if size > limit:
                        self._fold(ids, vectors, held, several)
                        held, size = [], 0
        self._fold(ids, vectors, held, several)

    def _fold(self, ids: np.ndarray, vectors: np.ndarray, held: list, several: bool) -> None:
        if not held:
            return
        q, v = (np.concatenate(x) for x in zip(*held))
        if several:  # a vector that stands in several lists comes once
            key = np.unique(q * len(ids) + v)
            q, v = key // len(ids), key % len(ids)
        other = self.ids[q] != ids[v]
        q, v = q[other], v[other]
        score = np.concatenate([np.zeros(0), *((self.queries[q[a : a + 65_536]] * vectors[v[a : a + 65_536]]).sum(1) for a in range(0, len(q), 65_536))])
        q, found, score = np.concatenate([self.q, q]), np.concatenate([self.found, ids[v]]), np.concatenate([self.score, score])
        order = np.lexsort((found, -score, q))
        if self.repeats > 1:  # an id that several rows have comes once, by its best score
            by_id = np.lexsort((-score, found, q))
            order = by_id[_starts(q[by_id], found[by_id])]
            order = order[np.lexsort((found[order], -score[order], q[order]))]
        rank = _rank(q[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.q, self.found, self.score = q[order], found[order], score[order]
        last = np.nonzero(rank == self.k - 1)[0]
        at = self.q[last]
        self.least[at] = np.maximum(self.least[at], self.score[last] * self.power[at] * self.space.scale - self.slack[at])

    def best(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.q]), pa.array(self.found), pa.array(self.score)], ["query_id", "vec_id", "score"])


def _score(k: int, repeats: int, space: Space):
    """Rows (id, embedding, lists, cell, block, side), sorted by the last three: queries (side 0), then vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asking, search = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 5)]
            edges = np.append(np.nonzero(_starts(*keys))[0], batch.num_rows).tolist()
            for a, b in zip(edges, edges[1:]):
                part, key = batch.slice(a, b - a), (int(keys[0][a]), int(keys[1][a]))
                if key != here:
                    if search:
                        yield search.best()
                    here, asking, search = key, [], None
                if keys[2][a] == 0:
                    asking.append(part)
                    continue
                if search is None and asking:
                    given = pa.Table.from_batches(asking).combine_chunks().to_batches()[0]
                    search = _Search(k, repeats, space, given.column(0).to_numpy(), matrix(given.column(1)), *_unfold(given.column(2)))
                if search:
                    search.show(part.column(0).to_numpy(), matrix(part.column(1)), *_unfold(part.column(2)))
        if search:
            yield search.best()

    return run


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = K, prune: float | None = None) -> DataFrame:
    """The k nearest found of each query: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows of another vec_id. A query gets k
    rows wherever there are so many candidates. Vectors that are null, zero or hold null or non-finite components take
    no part, nor do those of another length than most vectors. Of equal vectors, only the k + 1 smallest ids enter the
    lists: no others can be among the k nearest, so copies of one vector can't fill a list. Rows that repeat a vec_id
    are one candidate, by its best score, and one query, with the vector of the smallest hash. Without ``prune`` the
    table's own ratio is measured. An empty table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    clean = materialise(usable(vectors), "near-clean")
    common = clean.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("top")).orderBy(F.desc("n"), "width").first()
    if common is None:
        return spark.createDataFrame([], schema)
    clean, space = clean.filter(F.col("width") == common["width"]), Space(common["top"])
    kind = clean.schema["embedding"].dataType.simpleString()
    space.radius = clean.select("embedding").mapInArrow(_squares(space.scale), "square double").agg(F.max("square")).first()[0] ** 0.5
    own = clean.select("vec_id", "embedding")
    for sample in (hash_sample(own, "vec_id", SAMPLE, common["n"], 3), own.limit(SAMPLE)):  # the latter where few ids hold all rows
        trained = sample.select("embedding").coalesce(1).mapInArrow(_train(space), "centroid array<double>, weight double").collect()  # SAMPLE / PER_CENTROID rows at most
        if trained:
            break
    graph = CentroidGraph(np.array([r["centroid"] for r in trained]), np.array([r["weight"] for r in trained]))

    same = Window.partitionBy("key").orderBy("vec_id")
    few = clean.withColumn("copy", F.dense_rank().over(same)).filter(F.col("copy") <= k + 1)
    few = few.withColumn("before", F.lag("vec_id").over(same)).filter(~F.col("vec_id").eqNullSafe(F.col("before")))
    posted = materialise(few.select("vec_id", "embedding").mapInArrow(_post(graph, space), f"vec_id bigint, embedding {kind}, lists array<int>"), "near-lists")
    repeats = posted.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    sizes, held = np.zeros(len(graph.centroids), np.int64), np.zeros(len(graph.centroids), np.int64)
    for r in posted.select(F.posexplode("lists").alias("at", "list")).groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") == 0).alias("own")).collect():  # a row for each centroid at most
        sizes[r["list"]], held[r["list"]] = r["n"], r["own"]

    queries = clean.filter(F.col("vec_id") % every == 0)
    walks = min(TASKS, -(-queries.count() // WALK)) or 1
    queries = queries.repartition(walks, "vec_id").groupBy("vec_id").agg(F.min_by("embedding", "key").alias("embedding"))
    ratio, beam = measured_ratio(graph, queries, posted, space, k, repeats) if prune is None else (prune, BEAM)
    first, count = cells_of(sizes, max(1, -(-int(sizes.sum()) // CELLS)))
    asking = queries.mapInArrow(_ask(graph, ratio, space, (first, count), held, (k + 1) * repeats, beam), f"id bigint, embedding {kind}, lists array<int>, cell int")
    asked = materialise(asking, "near-asked")
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    tasks = blocks.agg(F.sum("blocks")).first()[0]
    if not tasks:
        return spark.createDataFrame([], schema)

    dealt = posted.mapInArrow(_deal((first, count)), f"id bigint, embedding {kind}, lists array<int>, cell int")
    mine = asked.join(blocks, "cell").select("id", "embedding", "lists", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"))
    theirs = dealt.join(blocks, "cell").select("id", "embedding", "lists", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"))
    # a number of partitions is given, so that small tables are not put into few tasks
    meeting = mine.unionByName(theirs).repartition(min(tasks, TASKS), "cell", "block").sortWithinPartitions("cell", "block", "side")
    scored = meeting.mapInArrow(_score(k, repeats, space), SCORED)
    best = scored.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
