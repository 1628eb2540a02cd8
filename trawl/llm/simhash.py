"""SimHash near-duplicate groups: fingerprints, a binary-trie self-join, connected components.

Fingerprints of 64 bits link at MOST_BITS = 2 differing bits or fewer. Of three bit blocks (22, 21, 21), at least one
is then equal on both sides; so the fingerprints are dealt three times, each time rotated so that another block comes
first, and every part (a range of first bits) joins its own binary trie with itself: node pairs are traversed together,
differing bits are summed on the way down, and a pair is pruned as soon as its sum exceeds the budget, which is none
within the first block. The trie is the sorted array of distinct fingerprints; a node is a range of it. Copies never
enter: the join sees distinct fingerprints only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import byte_view, materialise, quoted, row_key

SHINGLE, SEED, MOST_BITS = 3, 42, 2
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Node pairs with so few leaves on either side are compared leaf by leaf.
LEAF = 4
#: Node pairs handled at a time, and links gathered before they are folded.
FRONTIER, FOLD = 200_000, 2_000_000
#: Fingerprints of a part, on the average; one with more than CHUNK is split into pairs of chunks, each a task's.
PART, CHUNK = 4_000, 20_000
ROUNDS = 60


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the lower-cased (A-Z) text: bit set where over half of the shingle hashes have it set.

    Fewer words than a shingle: the whole sequence is the one shingle. No words: 0.
    """
    tokens = text.lower().split()  # for bytes: A-Z alone, and splits at \x20 \x09-\x0D
    n = len(tokens)
    if not n:
        return 0
    joined = b" ".join(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    ends = ends[words - 1 :].tolist()
    for k in range(0, len(starts), 65_536):  # bounded memory for texts of any length
        hashes = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[k : k + 65_536], ends[k : k + 65_536])), np.uint64)
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = byte_view(batch.column(1))
        ends = at.tolist()
        prints = np.fromiter((fingerprint(data[i:j]) for i, j in zip(ends, ends[1:])), np.uint64, len(ends) - 1)
        more = batch.schema.names[2:]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64), pa.int64()), *map(batch.column, more)], ["doc_id", "fp", *more])


# -- the trie join


def _cut(keys: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where the one-branch of each node [low, high) at this depth begins."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    ones = (keys & bit) != 0
    before = np.concatenate([[0], np.cumsum(ones)])
    return high - (before[high] - before[low])


def trie_pairs(left: np.ndarray, right: np.ndarray, budget: int = MOST_BITS, equal: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of left, j of right) of keys at most ``budget`` bits apart; both arrays are sorted and distinct.

    Pairs whose first ``equal`` bits differ may be left out. With left and right the same array, each unordered pair
    comes once, with i < j.
    """
    same = left is right
    if not len(left) or not len(right):
        return
    first = np.array([[0, len(left), 0, len(right), 0]], np.int64)
    stack = [(0, first)]
    while stack:
        depth, nodes = stack.pop()
        if len(nodes) > FRONTIER:
            stack += [(depth, nodes[FRONTIER:]), (depth, nodes[:FRONTIER])]
            continue
        small = ((nodes[:, 1] - nodes[:, 0]) <= LEAF) & ((nodes[:, 3] - nodes[:, 2]) <= LEAF) | (depth == 64)
        leaves, nodes = nodes[small], nodes[~small]
        if len(leaves):
            i = (leaves[:, 0, None, None] + np.arange(LEAF)[None, :, None]) + np.zeros((1, 1, LEAF), np.int64)
            j = (leaves[:, 2, None, None] + np.arange(LEAF)[None, None, :]) + np.zeros((1, LEAF, 1), np.int64)
            ok = (i < leaves[:, 1, None, None]) & (j < leaves[:, 3, None, None])
            if same:
                ok &= i < j
            i, j = i[ok], j[ok]
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            if near.any():
                yield i[near], j[near]
        if not len(nodes):
            continue
        a, b, c, d, used = nodes.T
        m, n = _cut(left, a, b, depth), _cut(right, c, d, depth)
        down = np.concatenate([np.stack([a, m, c, n, used], 1), np.stack([m, b, n, d, used], 1)])
        if depth >= equal:
            crossed = np.stack([m, b, c, n, used + 1], 1)
            if same:  # a node paired with itself has its two mixed branches only once
                crossed = crossed[(a != c) | (b != d)]
            down = np.concatenate([down, np.stack([a, m, n, d, used + 1], 1), crossed])
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= budget)]
        if len(down):
            stack.append((depth + 1, down))


def fold(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each of n items' component, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def spanning_links(left: np.ndarray, right: np.ndarray, equal: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(key, smallest key of its component) under the links between left and right: at most one per key."""
    same = left is right
    keys = left if same else np.union1d(left, right)
    a = np.arange(len(keys)) if same else np.searchsorted(keys, left)
    b = a if same else np.searchsorted(keys, right)
    root, held, size = np.arange(len(keys)), [], 0

    def settle() -> np.ndarray:
        got = [np.concatenate(x) for x in zip(*held)]
        rest = np.nonzero(root != np.arange(len(keys)))[0]
        return fold(len(keys), np.concatenate([got[0], rest]), np.concatenate([got[1], root[rest]]))

    for i, j in trie_pairs(left, right, equal=equal):
        held.append((a[i], b[j]))
        size += len(i)
        if size > FOLD:
            root, held, size = settle(), [], 0
    if held:
        root = settle()
    linked = np.nonzero(root != np.arange(len(keys)))[0]
    return keys[linked], keys[root[linked]]


def _join_part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    at, width = BLOCKS[int(key[0])]
    turn, back = np.uint64(at), np.uint64((64 - at) % 64)
    keys = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    keys = keys << turn | keys >> back if at else keys  # the block's bits come first
    side = pdf["side"].to_numpy()
    left = np.unique(keys[side == 0])
    right = left if (side == 0).all() else np.unique(keys[side == 1])
    found = [(k >> turn | k << back if at else k).view(np.int64) for k in spanning_links(left, right, width)]
    return pd.DataFrame({"fp": found[0], "to": found[1]})


def linked_fingerprints(prints: DataFrame) -> DataFrame:
    """Links (fp, to) among the distinct fp of prints that connect what is MOST_BITS bits apart or less.

    A part holds the fingerprints that agree in the first few bits of a block, as many bits as make PART of them on
    the average. One larger than CHUNK is dealt to pairs of chunks, so a task gets 2 x CHUNK fingerprints at most,
    whatever a part's share is; every pair of its fingerprints still meets in one task.
    """
    bits = min(20, max(0, (prints.count() // PART).bit_length()))
    first = [F.shiftrightunsigned(F.shiftleft("fp", at), 64 - bits) if bits else F.lit(0).cast("bigint") for at, _ in BLOCKS]
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), b.cast("bigint").alias("value")) for k, b in enumerate(first)])
    dealt = prints.select("fp", F.explode(blocks).alias("x")).select("fp", "x.block", "x.value")
    sizes = dealt.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = dealt.join(sizes.select("block", "value", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), ["block", "value"])
    parts = parts.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda k: F.struct(F.least(k, F.col("mine")).alias("a"), F.greatest(k, F.col("mine")).alias("b"), (k < F.col("mine")).cast("int").alias("side")),
    )
    tasks = parts.select("fp", "block", "value", F.explode(pairs).alias("p")).select("fp", "block", "value", "p.a", "p.b", "p.side")
    return tasks.groupBy("block", "value", "a", "b").applyInPandas(_join_part, "fp bigint, to bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component; links has (fp, to), any orientation.

    Each round hooks every node to the smallest root among its neighbours' and then jumps pointers; rounds follow the
    logarithm of the longest chain. Every round's labels are written to the shared folder.
    """
    both = links.select(F.col("fp").alias("a"), F.col("to").alias("b")).distinct()
    edges = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-edges")
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "near-labels")
    for _ in range(ROUNDS):
        # the smallest root next to each node, offered to the node and to its present root
        offers = edges.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        mine = labels.join(offers.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "r").alias("r"))
        hooks = mine.select(F.col("root").alias("node"), "r").unionByName(mine.select("node", "r")).groupBy("node").agg(F.min("r").alias("r"))
        hooked = materialise(labels.join(hooks, "node", "left").select("node", "root", F.least("root", F.coalesce("r", "root")).alias("new")), "near-hooks")
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("up"))
        jumped = hooked.join(jump, "new", "left").select("node", "root", F.least("new", F.coalesce("up", "new")).alias("new"))
        jumped = materialise(jumped, "near-labels")
        changed = jumped.filter("new <> root").isEmpty()
        labels = jumped.select("node", F.col("new").alias("root"))
        if changed:
            return labels
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts, and texts of white space, have fingerprint 0, linked like any other. Rows with a null id get
    a component like any other; component_id is null where a whole component has no id. Repeated rows share their
    component. An empty table gives an empty result; other columns of docs are not looked at.
    """
    pair = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, classes = _classes(pair.mapInArrow(_fingerprints, "doc_id bigint, fp bigint"))
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, fp) as written to the shared folder, and (fp, root, component_id) of each fingerprint."""
    rows = materialise(rows, "near-prints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "near-distinct")
    links = materialise(linked_fingerprints(prints.select("fp")), "near-links")
    roots = components(links).withColumnRenamed("node", "fp")
    classes = prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, classes.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of docs: one with the smallest doc_id, nulls last.

    Rows are told apart by id and text, so components without ids and rows that repeat an id keep one of their own;
    rows equal in both stay together.
    """
    key = row_key(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key"))
    rows, classes = _classes(given.mapInArrow(_fingerprints, "doc_id bigint, fp bigint, key string"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    name = f"near_key_{uuid.uuid4().hex}"  # docs may have columns of any name
    keep = rows.join(classes, "fp").groupBy("root").agg(first.alias("first")).select(F.col("first.key").alias(name))
    return docs.withColumn(name, key).join(keep, name, "left_semi").select(*map(quoted, docs.columns))
