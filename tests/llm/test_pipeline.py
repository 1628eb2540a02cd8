"""The pipeline against a brute-force version of each stage over the smallest documents."""

import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from trawl.llm import language_id, packing
from trawl.llm.common import byte_view


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(0)
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(hashes)) if len(hashes) else 0


def test_stages(spark, sf_dir):
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    out, columns, given = {}, docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, sf_dir).cache()
        if name != "packing":
            assert given.columns == columns
        out[name] = given.collect()
    # language: the network's own verdict on every whole text
    net = language_id.train(docs)
    ids = list(rows)
    means = net.documents(*byte_view(pa.array([rows[i]["text"] for i in ids], pa.string())))
    want = {i for i, m in zip(ids, means) if m.max() >= corpus_pipeline.LEAST_LANGUAGE_SCORE and any(map(str.isalpha, rows[i]["text"] or ""))}
    assert {r["doc_id"] for r in out["language_id"]} == want and len(want) > 0.95 * len(rows)
    # exact copies
    keep = {}
    for i in sorted(want):
        keep[lower(rows[i]["text"])] = i
    assert {r["doc_id"] for r in out["exact_dedup"]} == set(keep.values())
    # near copies
    left = sorted(keep.values())
    prints, root = [fingerprint(rows[i]["text"]) for i in left], list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    single = {left[k] for k in range(len(left)) if find(k) == k}
    assert {r["doc_id"] for r in out["near_dedup"]} == single
    # mixing: near the targets, whole copies
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i]["text"] or "")) for i in single}
    times = {}
    for r in out["source_mixing"]:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= single and max(times.values()) <= 2
    assert abs(sum(size[i] * n for i, n in times.items()) / (1.5 * sum(size.values())) - 1) < 0.01
    # packing: every id of every row once
    lengths = {i: len(packing.token_ids(rows[i]["text"] or "", packing.default_tokenizer())) + 1 for i in times}
    got = {}
    for r in out["packing"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: lengths[i] * n for i, n in times.items()}
    fills = {}
    for r in out["packing"]:
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    assert max(fills.values()) <= packing.CAPACITY


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_null_and_repeated_ids_lose_no_text(spark):
    alone = [" ".join(f"{w}{k}" for w in ("stone", "river", "cloud", "field", "tower", "lamp")) for k in range(8)]
    rows = [(None, alone[0]), (None, alone[1]), (None, alone[1].upper()), (5, alone[2]), (5, alone[3]), (5, alone[3]), (6, alone[4]), (None, alone[4]), (7, alone[4]), (None, None), (7, alone[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = sorted([(None, lower(alone[0])), (None, lower(alone[1])), (5, alone[2]), (5, alone[3]), (7, alone[4]), (None, ""), (7, alone[5])], key=str)
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert exact.columns == docs.columns and sorted([(r["doc_id"], lower(r["text"])) for r in exact.collect()], key=str) == want
    near = corpus_pipeline.drop_near_copies(spark, exact, "")
    assert near.columns == docs.columns and sorted([(r["doc_id"], lower(r["text"])) for r in near.collect()], key=str) == want


CLASHES = ["_keep", "_key", "_of", "_copies", "_copy", "key", "fp", "root", "rank", "copies", "size", "target", "of", "at", "part", "score", "lang_pred", "keep_id", "kept", "h128", "a.b", "length", "task"]


def odd_table(spark, rows):
    """rows of (doc_id, text, lang, source) with further columns named like what stages and operators use inside."""
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    full = [(*r, len(r[1] or ""), *[f"{c}{k}" for c in CLASHES]) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")


def odd_rows():
    rng = random.Random(3)
    words = {"aa": "abcde", "bb": "fghij"}
    said = lambda lang, n: " ".join("".join(rng.choice(words[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(k, said(("aa", "bb")[k % 2], rng.randint(5, 60)), ("aa", "bb")[k % 2], ("s1", "s2", None)[k % 3]) for k in range(60)]
    rows += [(100, None, "aa", "s1"), (101, "", "bb", "s1"), (None, said("aa", 30), None, None), (None, said("bb", 30), None, "s1"), (102, "a" * 300_000, "aa", "s2"), (103, said("aa", 30_000), "aa", "s1"), (104, "12 34", "aa", "s2")]
    rows += [rows[3], rows[3], (105, rows[3][1].upper(), "bb", "s2"), (7, said("aa", 20), "aa", "s1")]
    return rows


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_edges(spark, k):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns and the empty table, stage by stage."""
    name, stage = corpus_pipeline.STAGES[k]
    rows = odd_rows()
    docs = odd_table(spark, rows)
    given = [tuple(r) for r in docs.collect()]
    out = stage(spark, docs, "")
    got = [tuple(r) for r in out.collect()]
    assert stage(spark, docs.limit(0), "").count() == 0
    if name == "packing":
        lengths = [len(packing.token_ids(t or "", packing.default_tokenizer())) + 1 for _, t, _, _ in rows]
        assert sum(r[out.columns.index("length")] for r in got) == sum(lengths)
        assert {r[0] for r in got} == {r[0] for r in rows}
        return
    assert out.columns == docs.columns and set(got) <= set(given)  # every column of every row as it was
    texts = [r[1] for r in got]
    if name == "language_id":
        assert sorted(map(str, got)) == sorted(str(r) for r in given if r[1] and any(map(str.isalpha, r[1])))
    if name == "exact_dedup":
        assert sorted(lower(t) for t in texts) == sorted({lower(t) for _, t, _, _ in rows})
        ids = {lower(r[1]): r[0] for r in got}
        for text, i in ids.items():
            known = [x for x, t, _, _ in rows if lower(t) == text and x is not None]
            assert i == max(known, default=None)
    if name == "near_dedup":
        prints = {fingerprint(t) for _, t, _, _ in rows}
        assert {fingerprint(t) for t in texts} <= prints and len({lower(t) for t in texts}) == len({fingerprint(t) for t in texts})
        for t in {t for _, t, _, _ in rows}:
            assert any((fingerprint(t) ^ fingerprint(x)).bit_count() <= 2 for x in texts)
    if name == "source_mixing":
        words = lambda t: len((t or "").split())
        total = sum(words(t) for _, t, _, _ in rows)
        assert abs(sum(map(words, texts)) - 1.5 * total) <= 0.02 * total + 15_000  # half of the longest document
        assert all(got.count(r) <= 2 * given.count(r) for r in set(got))


def test_language_stage_with_nothing_to_learn(spark):
    docs = odd_table(spark, [(1, "some text", None, "s")])
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 0
