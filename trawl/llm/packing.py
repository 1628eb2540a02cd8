"""Packing token sequences by minimum bin slack over the counts of remaining lengths.

Documents are tokenised and cut into pieces of at most ``capacity`` ids. What matters for packing is only how many
pieces there are of each length, at most ``capacity`` numbers for any corpus. The plan takes the largest length left
as seed and finds, by subset-sum dynamic programming on a bitset, the multiset of other lengths that fills its window
closest to capacity; the multiset is read back from the stored bitsets and repeated as often as its lengths last, so
every step uses up a length. Pieces then find their place by their length and their rank among pieces of that length.
"""

from __future__ import annotations

import array
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from trawl.llm.common import byte_view, materialise

CAPACITY, END_ID = 2048, 1
#: Token strings that are kept per task; beyond it the cache starts anew.
CACHE_ENTRIES = 400_000
#: Pieces per Arrow batch, and bytes of the row groups that they are written in.
BATCH, ROW_GROUP = 1_000, 8 << 20


# -- tokenising


#: The pattern by which byte-level BPE splits texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merge_ranks(model: dict) -> dict[bytes, int] | None:
    """bytes -> id of a byte-level BPE whose merges stand in the order of their ids; None for any other model.

    Such a model's ids are its merge ranks, so a rank-based merger gives the same ids, several times as fast.
    """
    vocabulary = model.get("vocab")
    if model.get("type") != "BPE" or not isinstance(vocabulary, dict):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if [vocabulary.get(m) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    plain = [t for t, i in vocabulary.items() if i < 256 + len(merges)]
    return {bytes(letters[c] for c in t): vocabulary[t] for t in plain}


class _Cache(dict):
    """Chunk of text -> its ids as little-endian 16-bit bytes. Chunks start at a space before a non-space."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        whole = json.loads(tokenizer.to_str())
        split, ranks = whole.get("pre_tokenizer") or {}, merge_ranks(whole["model"])
        if ranks and not whole.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space"):
            self.encode = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.encode = lambda chunk: tokenizer.encode(chunk, add_special_tokens=False).ids

    def __missing__(self, chunk: str) -> bytes:
        found = array.array("H", self.encode(chunk)).tobytes()
        if len(chunk) < 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = found
        return found


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[_Cache, list[str]]:
    tokenizer = Tokenizer.from_file(path)
    if tokenizer.get_vocab_size() > 65_536:
        raise ValueError("ids must fit 16 bits")
    return _Cache(tokenizer), [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, as 16-bit numbers.

    A byte-level BPE splits texts before it merges, and a single space that a non-space follows always starts such a
    split; so the text is cut there, and equal chunks are encoded once. Texts that hold an added token's string or
    other white space than single spaces and line feeds are encoded whole.
    """
    cache, added = _tokenizer(path)
    if any(t in text for t in added):
        return np.array(cache.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
    parts = text.split(" ")
    if "" in parts:  # runs of spaces, or one at either end: only the last space of a run belongs to the next chunk
        chunks, held = [], ""
        for k, part in enumerate(parts):
            chunk = " " + part if k else part
            if part and not part[0].isspace():
                if held:
                    chunks.append(held)
                held = chunk
            else:
                held += chunk
        return np.frombuffer(b"".join(map(cache.__getitem__, [*chunks, held])), np.uint16) if text else np.zeros(0, np.uint16)
    if any(p[0].isspace() for p in parts):
        merged = [parts[0]]
        for part in parts[1:]:
            if part[0].isspace():
                merged[-1] += " " + part
            else:
                merged.append(part)
        parts = merged
    first, rest = parts[0], parts[1:]
    get = cache.__getitem__
    return np.frombuffer(get(first) + b"".join([get(" " + p) for p in rest]), np.uint16) if text else np.zeros(0, np.uint16)


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def _cut(path: str, capacity: int, end_id: int):
    names = [f.name for f in PIECES]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        nth = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this task
        for batch in batches:
            data, at = byte_view(batch.column(1))
            ends, doc_ids = at.tolist(), batch.column(0).cast(pa.int64()).to_pylist()
            rows: list = [[] for _ in names]
            for doc, i, j in zip(doc_ids, ends, ends[1:]):
                ids = np.append(token_ids(data[i:j].decode("utf-8", "replace"), path), np.uint16(end_id))
                total, wide = len(ids), ids.astype("<u4")
                for start in range(0, total, capacity):
                    piece = wide[start : start + capacity].tobytes()
                    length = len(piece) // 4
                    for column, value in zip(rows, (doc, start, length, total, task, int(nth[length]), zlib.crc32(piece), piece)):
                        column.append(value)
                    nth[length] += 1
                if len(rows[0]) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)
                    rows = [[] for _ in names]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    return run


# -- planning


def padding(fill: int, capacity: int = CAPACITY) -> int:
    """Ids of padding of a sequence of so many ids: none at a power of two, else up to capacity."""
    return 0 if fill & (fill - 1) == 0 else capacity - fill


def best_fill(counts: dict[int, int], room: int, taken: int, capacity: int = CAPACITY) -> list[int]:
    """The multiset of lengths (each at most counts[length] times) whose sum leaves the least padding beside ``taken``.

    reach is a bitset of the sums that the lengths so far can make; a length with count c enters in powers of two, so
    it takes log2(c) shifts. Every stage's bitset is kept, and the sum chosen is traced back through them.
    """
    mask, reach, stages = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(size, left)
            stages.append((length * take, length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    sums = [s for s in range(room + 1) if reach >> s & 1] if not reach >> room & 1 else [room]
    target = min(sums, key=lambda s: (padding(taken + s, capacity), -s))
    chosen = []
    for weight, length, take, before in reversed(stages):
        if not before >> target & 1:
            target -= weight
            chosen += [length] * take
    return chosen


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(lengths of a sequence with their multiplicity, number of such sequences)], using every piece once."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        seed = max(left)
        rest = {k: v - (k == seed) for k, v in left.items()}
        chosen = [seed, *best_fill({k: v for k, v in rest.items() if v}, capacity - seed, seed, capacity)]
        pattern: dict[int, int] = {}
        for length in chosen:
            pattern[length] = pattern.get(length, 0) + 1
        times = min(left[k] // m for k, m in pattern.items())
        plan.append((pattern, times))
        left = {k: n for k, v in left.items() if (n := v - times * pattern.get(k, 0))}
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """(length, first, last, each, sequence, offset): the ranges of ranks [first, last) of a length that a pattern takes,
    so many in each of its sequences, and where it puts them."""
    rows, used, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            m, first = pattern[length], used.get(length, 0)
            rows.append((length, first, first + m * times, m, sequence, offset))
            used[length] = first + m * times
            offset += m * length
        sequence += times
    return rows


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, 32-bit little-endian).

    With ids, the checksum is that of the ids in their place; without, it is taken when the text is cut.

    A document is its ids and end_id; null and empty texts are end_id alone. It is cut only where it is longer than
    capacity. Pieces of repeated rows are packed like any others. An empty table gives an empty result; other columns
    of docs are not looked at. The tokenised pieces are written once to the shared folder, so a lost task can't
    renumber them.
    """
    spark = docs.sparkSession
    pair = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = T.StructType([f for f in PIECES if f.name != ("ids_crc32" if with_ids else "ids")])
    pieces = materialise(pair.mapInArrow(_cut(tokenizer or default_tokenizer(), capacity, end_id), PIECES).select(*[f.name for f in kept]), "pack-pieces", ROW_GROUP)
    per_task = materialise(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    if not histogram:
        more = [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", *(["ids_crc32"] if with_ids else []))]
        return spark.createDataFrame([], T.StructType([*[f for f in kept if f.name not in ("task", "nth")], *more]))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("base"))
    meta = pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "task", "nth")
    names = [f for f in kept if f.name not in ("task", "nth")]
    columns = [f.name for f in names]
    # every step of the plan uses up a length, and a sequence holds few different ones, so the ranges are few whatever
    # the corpus is: at most capacity steps of sqrt(2 x capacity) lengths, 40 bytes each
    ranges = spark.createDataFrame(places(pack_plan(histogram, capacity)), "of bigint, first bigint, last bigint, each bigint, sequence bigint, at bigint")
    nth = F.col("rank") - F.col("first")
    within = F.pmod(nth, F.col("each"))  # one sequence may take several pieces of a length
    placed = meta.join(F.broadcast(ranges), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    packed = placed.select(*columns, (F.col("sequence") + (nth - within) / F.col("each")).cast("bigint").alias("sequence_id"), (F.col("at") + within * F.col("length")).cast("bigint").alias("offset"))
    return packed.withColumn("ids_crc32", F.crc32("ids")) if with_ids else packed
