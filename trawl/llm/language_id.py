"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text in windows of WINDOW bytes, forwards and backwards, and gives every byte position a
probability for each language; the mean over all positions of the whole text is the document's. Its state starts anew
in each window, and its gates use a piecewise linear sigmoid. It is trained by backpropagation through time on a
bounded sample of labelled windows from all over the sampled texts, equally many for each language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import byte_view, crc_remainder, crc_remainder_column

WINDOW, HIDDEN = 96, 16
#: Training: documents sampled at most, unless that is fewer than LEAST_DOCS for each language, and windows of WINDOW
#: characters taken from each, one from each of so many equal parts of its text.
SAMPLE_DOCS, LEAST_DOCS, PLACES = 4000, 40, 6
STEPS, BATCH, RATE = 200, 160, 0.012
#: Windows that a task reads at a time.
LANES = 2048
UNKNOWN = "und"


#: Slope of the gates' straight middle part.
SLOPE = np.float32(0.25)


def gate(x: np.ndarray) -> np.ndarray:
    """The piecewise linear sigmoid of the gates: 1/2 + x/4 between 0 and 1."""
    return np.clip(x * SLOPE + np.float32(0.5), 0, 1)


class BiGru:
    """Weights: for each direction tables of the three gates' input (256 x H) and their recurrent H x H matrices."""

    def __init__(self, languages: list[str], seed: int = 0):
        self.languages, n, h = languages, len(languages), HIDDEN
        rng = np.random.default_rng(seed)
        self.p = {}
        for way in "fb":
            for name in "zrn":
                self.p[f"x{name}{way}"] = rng.normal(0, 0.3, (256, h)).astype(np.float32)
                self.p[f"u{name}{way}"] = rng.normal(0, h**-0.5, (h, h)).astype(np.float32)
            self.p[f"o{way}"] = rng.normal(0, h**-0.5, (h, n)).astype(np.float32)
        self.p["bias"] = np.zeros(n, np.float32)

    # -- training

    def _run(self, way: str, codes: np.ndarray, mask: np.ndarray) -> list:
        p, h, trace = self.p, np.zeros((codes.shape[1], HIDDEN), np.float32), []
        steps = range(len(codes)) if way == "f" else range(len(codes) - 1, -1, -1)
        for t in steps:
            c, m = codes[t], mask[t][:, None]
            z = gate(p["xz" + way][c] + h @ p["uz" + way])
            r = gate(p["xr" + way][c] + h @ p["ur" + way])
            un = h @ p["un" + way]
            n = np.tanh(p["xn" + way][c] + r * un)
            new = (n + z * (h - n)) * m
            trace.append((t, h, z, r, un, n, new))
            h = new
        return trace

    def gradients(self, codes: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy per position and its gradients; codes and mask are (time, lane)."""
        p, grads = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        traces = {way: self._run(way, codes, mask) for way in "fb"}
        states = {way: {x[0]: x[6] for x in traces[way]} for way in "fb"}
        count, loss, into = mask.sum(), 0.0, {"f": {}, "b": {}}
        lane = np.arange(codes.shape[1])
        for t in range(len(codes)):
            logits = states["f"][t] @ p["of"] + states["b"][t] @ p["ob"] + p["bias"]
            logits -= logits.max(1, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(1, keepdims=True)
            loss -= (np.log(prob[lane, target] + 1e-9) * mask[t]).sum()
            prob[lane, target] -= 1
            prob *= mask[t][:, None] / count
            grads["bias"] += prob.sum(0)
            for way in "fb":
                grads["o" + way] += states[way][t].T @ prob
                into[way][t] = prob @ p["o" + way].T
        for way in "fb":
            dh, into_input = np.zeros((codes.shape[1], HIDDEN), np.float32), {name: [] for name in "zrn"}
            for t, h, z, r, un, n, _ in reversed(traces[way]):
                dh = (dh + into[way][t]) * mask[t][:, None]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * SLOPE * ((z > 0) & (z < 1))
                dr = dn * un * SLOPE * ((r > 0) & (r < 1))
                dun = dn * r
                for name, d in (("z", dz), ("r", dr), ("n", dn)):
                    into_input[name].append(d)
                grads["uz" + way] += h.T @ dz
                grads["ur" + way] += h.T @ dr
                grads["un" + way] += h.T @ dun
                dh = dh * z + dz @ p["uz" + way].T + dr @ p["ur" + way].T + dun @ p["un" + way].T
            seen = np.concatenate([codes[x[0]] for x in reversed(traces[way])])
            slots = (seen[:, None] * HIDDEN + np.arange(HIDDEN)).ravel()
            for name, d in into_input.items():
                total = np.bincount(slots, np.concatenate(d).ravel(), 256 * HIDDEN)
                grads[f"x{name}{way}"] += total.reshape(256, HIDDEN).astype(np.float32)
        return float(loss / count), grads

    def fit(self, windows: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 1) -> BiGru:
        rng, first, second = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        codes, mask = _matrix(windows)
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), min(BATCH, len(windows)))
            _, grads = self.gradients(codes[:, pick], mask[:, pick], labels[pick])
            norm = sum(float((g * g).sum()) for g in grads.values()) ** 0.5
            rate = RATE * min(1.0, step / 30) * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return self

    # -- inference

    def position_sums(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Per lane, the sum over its positions of the language probabilities; codes and mask are (time, lane)."""
        p, (steps, lanes), n = self.p, codes.shape, len(self.languages)
        # the gates' slope and middle are folded into their weights once
        scaled = {k: v * SLOPE + (np.float32(0.5) if k[0] == "x" else 0) if k[1] in "zr" and k[0] in "xu" else v for k, v in p.items()}
        hs = np.zeros((steps + 1, lanes, HIDDEN), np.float32)
        z, r, new, work = (np.empty((lanes, HIDDEN), np.float32) for _ in range(4))
        ragged = not mask.all()

        def step(way: str, c: np.ndarray, h: np.ndarray, out: np.ndarray) -> None:
            for name, at in (("z", z), ("r", r)):
                np.take(scaled[f"x{name}{way}"], c, axis=0, out=at, mode="clip")
                np.matmul(h, scaled[f"u{name}{way}"], out=work)
                np.add(at, work, out=at)
                np.maximum(at, np.float32(0), out=at)
                np.minimum(at, np.float32(1), out=at)
            np.matmul(h, scaled["un" + way], out=work)
            np.multiply(work, r, out=work)
            np.take(scaled["xn" + way], c, axis=0, out=new, mode="clip")
            np.add(new, work, out=new)
            np.tanh(new, out=new)
            np.subtract(h, new, out=work)
            np.multiply(work, z, out=work)
            np.add(new, work, out=out)

        for t in range(steps):
            step("f", codes[t], hs[t - 1] if t else hs[steps], hs[t])
        sums, back = np.zeros((lanes, n), np.float32), np.zeros((lanes, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            step("b", codes[t], back, back)
            if ragged:
                back *= mask[t][:, None]
            logits = hs[t] @ p["of"]
            logits += back @ p["ob"]
            logits += p["bias"]
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits *= (mask[t] / logits.sum(1))[:, None]
            sums += logits
        return sums

    def documents(self, data: bytes, at: np.ndarray) -> np.ndarray:
        """Mean position probabilities of each text data[at[i]:at[i + 1]]; zeros for an empty one."""
        sizes = np.diff(at)
        pieces = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = at[:-1][owner] + nth * WINDOW
        lengths = np.minimum(WINDOW, at[1:][owner] - starts)
        flat = np.frombuffer(data + bytes(WINDOW), np.uint8)
        sums = np.zeros((len(sizes), len(self.languages)))
        order = np.argsort(-lengths, kind="stable")  # full windows together need no mask
        steps = np.arange(WINDOW)
        for k in range(0, len(order), LANES):
            some = order[k : k + LANES]
            codes = np.ascontiguousarray(flat[starts[some][:, None] + steps].T)
            mask = np.ascontiguousarray((steps[:, None] < lengths[some]).astype(np.float32))
            np.add.at(sums, owner[some], self.position_sums(codes.astype(np.intp), mask))
        return sums / np.maximum(sizes, 1)[:, None]


def _matrix(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.zeros((WINDOW, len(windows)), np.intp)
    mask = np.zeros((WINDOW, len(windows)), np.float32)
    for k, w in enumerate(windows):
        codes[: len(w), k] = np.frombuffer(w, np.uint8)
        mask[: len(w), k] = 1
    return codes, mask


def training_sample(docs: DataFrame, most: int = SAMPLE_DOCS) -> list:
    """Rows (texts, lang): PLACES windows from all over each sampled text, about as many texts for each language.

    The parts of a text are equally long; the window's place in its part is set by the id's hash. A text of fewer than
    PLACES windows is taken whole. Only rows whose crc32(doc_id as text) mod 3 is not 1. Each row's key is uniform times its language's count, so
    the smallest keys hold the languages evenly; every language is learned. A language with few rows gives
    all of them, and the others don't fill its share.
    """
    rows = docs.filter((crc_remainder_column("doc_id") != 1) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()}  # a row per language
    if not counts:
        return []
    most = max(most, LEAST_DOCS * len(counts))
    count = F.element_at(F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("lang"))
    uniform = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_003)) + 1) / 1_000_004
    # the length is taken as a column of its own: substring in a lambda would count it again for every part
    part = F.floor(F.col("length") / PLACES)
    shift = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(12)), F.greatest(part - WINDOW, F.lit(0)) + 1)
    whole = F.col("length") <= PLACES * WINDOW
    places = F.when(whole, F.array(F.col("text"))).otherwise(F.array(*[F.substr("text", (part * k + shift + 1).cast("int"), F.lit(WINDOW)) for k in range(PLACES)]))
    # keys lie evenly at one a unit in every language, so twice the wanted rows, and no more, pass this
    near = rows.filter(F.col("lang").isin(list(counts))).withColumn("key", uniform * count).filter(F.col("key") <= 2 * most / len(counts))
    picked = near.withColumn("length", F.length("text")).select("key", "doc_id", "lang", places.alias("texts"))
    return picked.orderBy("key", "doc_id", "lang", "texts").limit(most).collect()


def train(docs: DataFrame) -> BiGru | None:
    """A network fitted to the sample; None where no row has a text and a language."""
    rows = training_sample(docs)
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    number, windows, labels = {k: i for i, k in enumerate(languages)}, [], []
    for r in rows:
        for data in map(str.encode, r["texts"]):
            windows += [data[k : k + WINDOW] for k in range(0, len(data), WINDOW)]
            labels += [number[r["lang"]]] * -(-len(data) // WINDOW)
    net = BiGru(languages)
    return net.fit(windows, np.array(labels)) if len(languages) > 1 else net


def has_letter(data: bytes) -> bool:
    return re.search(rb"[A-Za-z]", data) is not None or (not data.isascii() and any(map(str.isalpha, data.decode("utf-8", "replace"))))


def _predict(net: BiGru | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_view(batch.column(1))
            ids = batch.column(0).cast(pa.int64())
            n = len(ids)
            means = net.documents(data, at) if net else np.zeros((n, 1))
            best = means.argmax(1) if n else np.zeros(0, np.int64)
            ends = at.tolist()
            letters = [net is not None and has_letter(data[i:j]) for i, j in zip(ends, ends[1:])]
            names = [net.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters)]
            score = np.where(letters, np.clip(means[np.arange(n), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(crc_remainder(ids.to_pylist()) == 1), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: BiGru | None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (the pooled probability of lang_pred).

    Null texts and texts without a letter are ``und`` with score 0, and so is every text where nothing could be
    learned. Every byte of a text is read, whatever its length. Repeated rows get equal results; an empty table gives
    an empty result; other columns of docs are not looked at.
    """
    pair = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pair.mapInArrow(_predict(net), "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))


def keep_identified(docs: DataFrame, net: BiGru | None, least_score: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with at least least_score."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predict(net)
        for batch in batches:
            ids = pa.nulls(batch.num_rows, pa.int64())
            found = next(predict(iter([pa.RecordBatch.from_arrays([ids, batch.column(at)], ["doc_id", "text"])])))
            keep = [lang != UNKNOWN and score >= least_score for lang, score in zip(found.column(2).to_pylist(), found.column(3).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
