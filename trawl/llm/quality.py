"""Quality classifier: histogram gradient-boosted trees over statistics of a document's bytes, words and lines."""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import byte_view, crc_remainder, crc_remainder_column, hash_sample

#: Labelled rows that are learned from at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 80, 4, 64, 0.15, 20.0, 1.0

LETTERS = bytes(b for b in range(256) if chr(b).isascii() and chr(b).isalpha())
UPPERCASE, DIGITS, SPACE = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c"
SYMBOLS = [bytes([b]) for b in b"#$%&*!|.,;:?@/<>{}()[]=_-\"'"]


def statistics(data: bytes) -> list[float]:
    """Statistics of a whole text. Shares are of its bytes, words or lines; an empty text has zeros."""
    n = max(len(data), 1)
    words, lines = data.split(), data.split(b"\n")
    w = max(len(words), 1)
    plain = n - len(data.translate(None, LETTERS)) if data else 0
    upper = len(data) - len(data.translate(None, UPPERCASE))
    high = len(data) - len(data.translate(None, bytes(range(128, 256))))
    out = [
        np.log1p(len(data)), np.log1p(len(words)), plain / n, high / n, upper / max(plain, 1),
        (len(data) - len(data.translate(None, DIGITS))) / n, (len(data) - len(data.translate(None, SPACE))) / n,
        sum(map(len, words)) / w, max(map(len, words), default=0), len(set(words)) / w,
        sum(map(operator.eq, words, words[1:])) / w, sum(x.isupper() for x in words) / w, sum(x[-1:] in b".!?" for x in words) / w,
        sum(len(x) <= 3 for x in words) / w, sum(x[:1].isupper() for x in words) / w,
        len(lines) / n, len(set(lines)) / len(lines), max(map(len, lines)) / n, len(zlib.compress(data, 1)) / n,
    ]
    return out + [data.count(s) / w for s in SYMBOLS]


FEATURES = len(statistics(b""))


class Boosted:
    """Trees flattened into arrays (tree, node); node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for k in range(0, len(x), 4096):
            some = x[k : k + 4096]
            rows, node = np.arange(len(some))[:, None], np.zeros((len(some), len(trees)), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (some[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total[k : k + 4096] += self.value[trees, node].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    """Logistic boosting; each level finds all its nodes' best splits from histograms of gradients per binned feature."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    inner, total = 2**DEPTH - 1, 2 ** (DEPTH + 1) - 1
    feature, threshold, value = np.zeros((trees, total), np.int64), np.full((trees, total), np.inf), np.zeros((trees, total))
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate / (1 - rate)))
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            at = (node - first) * BINS
            best = np.full(count, 1e-9)
            for f in range(width):
                if not len(edges[f]):
                    continue
                slot = at + binned[:, f]
                gs = np.bincount(slot, g, count * BINS).reshape(count, BINS).cumsum(1)
                hs = np.bincount(slot, h, count * BINS).reshape(count, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain = np.round(gain, 9)  # equal splits tie whatever the order of the rows; the first feature and cut win
                gain[(hs < LEAST / 8) | (ht - hs < LEAST / 8)] = -1
                gain = gain[:, : len(edges[f])]
                cut = gain.argmax(1)
                top = gain[np.arange(count), cut]
                better = top > best
                best[better] = top[better]
                feature[t, first : first + count][better] = f
                threshold[t, first : first + count][better] = edges[f][cut[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        g_leaf, h_leaf = np.bincount(node, g, total), np.bincount(node, h, total)
        value[t, inner:] = (RATE * g_leaf / (h_leaf + RIDGE))[inner:]
        score += value[t, node]
    return Boosted(feature, threshold, value, base)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = byte_view(batch.column(2))
        ends = at.tolist()
        x = [statistics(data[i:j]) for i, j in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Boosted | None:
    """Trees fitted to at most SAMPLE labelled rows with crc32(doc_id as text) mod 3 other than 1; None without any.

    The sample is the ids with the smallest hashes, so at most SAMPLE ids are broadcast.
    """
    ids = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_remainder_column("doc_id") != 1))
    ids = ids.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    picked = hash_sample(ids, "doc_id", most, ids.count(), 5)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
    # repeats of an id could pass the bound again
    found = rows.mapInArrow(_statistics, "doc_id bigint, quality int, x array<double>").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "x").limit(most).collect()
    if not found:
        return None
    return boost(np.array([r["x"] for r in found]), np.array([r["quality"] for r in found], float))


def _score(model: Boosted | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_view(batch.column(1))
            ends, ids = at.tolist(), batch.column(0).cast(pa.int64())
            x = np.array([statistics(data[i:j]) for i, j in zip(ends, ends[1:])]).reshape(-1, FEATURES)
            score = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([ids, pa.array(crc_remainder(ids.to_pylist()) == 1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Scores come from the whole text alone; null counts as empty, and an empty text gets the score of its (zero)
    statistics. Without a labelled row every score is 0.5. Repeated rows get equal scores; an empty table gives an
    empty result; other columns of docs are not looked at.
    """
    pair = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pair.mapInArrow(_score(train(docs, labels)), "doc_id bigint, held_out boolean, score double, predicted int")
