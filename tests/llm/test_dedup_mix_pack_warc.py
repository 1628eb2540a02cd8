"""Exact dedup, SimHash groups, mixing, packing and WARC against brute force on small tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trawl.llm import exact_dedup, mixing, packing, simhash, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, h128 int, size double, rank int"


def docs(spark, rows):
    """rows of (doc_id, text[, source]); extra columns with names that operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", 1, 2.0, 3) for r in rows]
    return spark.createDataFrame(full, DOCS)


CASES = [(1, "Same Text"), (2, "same text"), (7, "SAME TEXT"), (3, None), (4, ""), (5, "É"), (6, "é"), (8, "x" * 300_000), (9, "X" * 300_000), (None, "alone"), (10, "a b"), (10, "a b")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs(spark, CASES)).collect()
    assert len(got) == len(CASES)
    groups = {}
    for i, t in CASES:
        groups.setdefault(hashlib.sha256(lower(t).encode()).hexdigest(), []).append(i)
    for r in got:
        mine = groups[r["text_sha256"]]
        top = max((i for i in mine if i is not None), default=None)
        assert r["group_size"] == len(mine) and r["keep_id"] == top and r["kept"] == (r["doc_id"] is not None and r["doc_id"] == top)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("values", [1, 3])
def test_exact_dedup_survives_hash_collisions(spark, values):
    """With a 128-bit hash of so few values, only the comparison of bytes tells texts apart."""

    def digest(data):
        return bytes([len(bytes(data)) % values]) * 16

    key = lambda r: str((r["doc_id"], r["text_sha256"], r["keep_id"], r["group_size"], r["kept"]))
    table = docs(spark, CASES)
    assert sorted(exact_dedup.exact_dedup(table, digest=digest).collect(), key=key) == sorted(exact_dedup.exact_dedup(table).collect(), key=key)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_groups(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [find(x) for x in range(len(prints))]


def test_fingerprints():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "Two words", "a b c", "a  b c\x0bd é E", *(" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 200))) for _ in range(30))]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == brute_print(t)


@pytest.mark.parametrize("seed", range(6))
def test_trie_join_finds_every_pair(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 4), replace=False))) for b in base for _ in range(40)]
    keys = np.unique(np.array([*near, 0, 2**64 - 1, 1, 3], np.uint64))
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= 2}
    got = [(int(x), int(y)) for i, j in simhash.trie_pairs(keys, keys) for x, y in zip(i, j)]
    assert len(got) == len(set(got)) and set(got) == want
    left, right = keys[::2], keys[1::2]
    got = {(int(left[x]), int(right[y])) for i, j in simhash.trie_pairs(left, right) for x, y in zip(i, j)}
    assert got == {(int(a), int(b)) for a in left for b in right if int(a ^ b).bit_count() <= 2}
    key, root = simhash.spanning_links(keys, keys)
    groups = brute_groups([int(k) for k in keys])
    found = dict(zip(key.tolist(), root.tolist()))
    assert [found.get(int(k), int(k)) for k in keys] == [int(keys[g]) for g in groups]


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    rows = list(CASES)
    for k in range(60):
        copy = list(base)
        copy[rng.randrange(400)] = rng.choice(words)
        rows.append((100 + k, " ".join(copy)))
    want = brute_groups([brute_print(t) for _, t in rows])
    smallest = {}
    for (i, _), g in zip(rows, want):
        known = [x for x in (i, smallest.get(g)) if x is not None]
        smallest[g] = min(known, default=None)
    for chunk in (simhash.CHUNK, 7):  # whole parts, and parts split into pairs of chunks
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = simhash.near_duplicates(docs(spark, rows)).collect()
        assert len(got) == len(rows)
        expected = {(i, f"{brute_print(t):016x}", smallest[g]) for (i, t), g in zip(rows, want)}
        assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == expected
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(k + 1, k) if k % 2 else (k, k + 1) for k in range(n)], "fp bigint, to bigint")
    assert {(r["node"], r["root"]) for r in simhash.components(links).collect()} == {(k, 0) for k in range(n + 1)}


def brute_targets(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, (s or "").encode())), [5, 2, 1] * len(sizes)))
    budget, fixed, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        level = (budget - sum(fixed.values())) / sum(weights[s] for s in free)
        full = [s for s in free if level * weights[s] > 2 * sizes[s]]
        if not full:
            return fixed | {s: level * weights[s] for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in full}
        free -= set(full)
    return fixed


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * min(900, int(rng.paretovariate(0.9)))), rng.choice(["a", "b", "B", "c", "é", None, "d"])) for k in range(900)]
    rows += [(2000, None, "a"), (2001, "", None), (2002, "x y", "tiny"), (2003, None, "void"), *[(3000 + k, "one two three", "same") for k in range(300)]]
    table = docs(spark, rows)
    got = mixing.mix_sources(table).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets, taken = brute_targets(sizes), {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(2.0, 0.01 * t), s
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(table.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    out = mixing.mixed_documents(table, mixing.mix_sources(table))
    assert out.columns == table.columns and out.count() == sum(r["copies"] for r in got)


def test_running_sums(spark):
    rng, rows = random.Random(3), []
    for g in ("a", "b", None, "c"):
        rows += [(g, k, rng.randint(0, 9)) for k in range({"a": 900, None: 300}.get(g, 5))]  # one group holds most rows
    rng.shuffle(rows)
    got = mixing.running(spark.createDataFrame(rows, "g string, k int, n bigint"), ["g"], [F.col("k").desc()], {"before": F.col("n"), "place": F.lit(1)}).collect()
    assert len(got) == len(rows)
    for r in got:
        ahead = [n for g, k, n in rows if g == r["g"] and k > r["k"]]
        assert (r["before"], r["place"]) == (sum(ahead), len(ahead))
    plain = mixing.running(spark.createDataFrame(rows, "g string, k int, n bigint"), [], [F.col("g").asc_nulls_last(), F.col("k").asc()], {"place": F.lit(1)})
    assert sorted(r["place"] for r in plain.collect()) == list(range(len(rows)))


def test_many_sources(spark):
    rows = [(k, "w " * (k % 7 + 1), f"s{k % 250}") for k in range(2000)]
    sizes, targets = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for r in mixing.mix_sources(docs(spark, rows)).collect():
        targets[r["source"]] = r["target"]
    assert targets == pytest.approx(brute_targets(sizes))


def test_unmet_constraints_raise(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError):
        mixing.mix_sources(docs(spark, [(k, "w " * (k + 1), "ab"[k % 2]) for k in range(40)]))


def test_mixing_runs_without_python(spark):
    plan = mixing.mix_sources(docs(spark, CASES))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_best_fill_is_optimal():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.randint(4, 40)
        counts = {rng.randint(1, capacity): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        taken = rng.randint(1, capacity)
        room = capacity - taken
        sums = {0}
        for length, c in counts.items():
            sums = {s + k * length for s in sums for k in range(c + 1) if s + k * length <= room}
        chosen = packing.best_fill(counts, room, taken, capacity)
        assert all(chosen.count(x) <= counts[x] for x in chosen)
        assert packing.padding(taken + sum(chosen), capacity) == min(packing.padding(taken + s, capacity) for s in sums)


def test_pack_plan_uses_every_piece_once():
    rng = random.Random(1)
    for _ in range(20):
        counts = {rng.randint(1, 2048): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
        used = {}
        for pattern, times in packing.pack_plan(counts):
            assert times >= 1 and sum(k * m for k, m in pattern.items()) <= 2048
            for k, m in pattern.items():
                used[k] = used.get(k, 0) + m * times
        assert used == counts


def test_token_ids_of_wide_unicode():
    """The merger against the tokenizers library on random strings of all planes, combining marks and very long words."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, rng = Tokenizer.from_file(path), random.Random(12)
    pools = ["abcdefghij'", " \n\t\u00a0\u2003", "éüßñçøåÅ", "日本語한국어ไทย", "\u0301\u0308\u200d\ufe0f", "😀👩🏽🇩🇪", "0123456789", "!?.,;:<|>-", "\x00\x01\x7f\u0085", "العربيةעברית"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(pools)) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(0, 60)))
        assert packing.token_ids(text, path).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    for long in ("a" * 30_000, "ab" * 20_000, "é" * 20_000, " " * 5000 + "x"):
        assert packing.token_ids(long, path).tolist() == plain.encode(long, add_special_tokens=False).ids


def test_token_ids():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, rng = Tokenizer.from_file(path), random.Random(4)
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "it's  he'll\n\n\tx", "<|endoftext|> a", "é ü  日本 x", "a　 b", "\n \n a", "x   y", "1 2  3 !!  ??"]
    texts += ["".join(rng.choice("ab1'.s \n\t é") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for t in texts:
        assert packing.token_ids(t, path).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    rows = [r for r in CASES] + [(100 + k, " ".join(rng.choice(["the", "xq", "and", "Ünder"]) for _ in range(int(rng.paretovariate(0.6)) % 9000))) for k in range(60)]
    got = packing.pack_documents(docs(spark, rows)).toPandas()
    tokenizer, seen = Tokenizer.from_file(packing.default_tokenizer()), 0
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    for r in got.itertuples():
        own = ids[None if np.isnan(r.doc_id) else r.doc_id]
        piece = np.array(own[r.start : r.start + r.length], "<u4").tobytes()
        assert r.doc_tokens == len(own) and r.ids == piece and r.ids_crc32 == zlib.crc32(piece)
        seen += r.length
    assert seen == sum(len(ids[i]) for i, _ in rows)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length.to_numpy())[:-1].tolist()] and s.length.sum() <= 2048
    assert packing.pack_documents(docs(spark, [])).count() == 0


PAGES = "page_id bigint, url string, html string, data string, block int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], PAGES)


def test_warc_round_trip(spark):
    evil = "x" * 30_000 + "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nfoo WARC/1.0\r\n" + "é" * 40_000
    rows = [(1, "http://a", "<p>x"), (2, None, None), (3, "b c\r\nd", ""), (4, "u", evil), (5, "u", "<p>x"), (6, "u", "\r\n\r\n"), (7, "u", "WARC/1.0\r\n"), (8, "u", evil), (9, "u", "<p>y"), (None, "u", "only")]
    rows += [(20 + k, "u", f"<p>{k}" * (k * 37)) for k in range(60)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # records cross splits
    try:
        got = {r["page_id"]: r for r in warc.warc_round_trip(pages(spark, rows).coalesce(2)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    last = {h or "": i for i, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0]))}
    for i, _, h in rows:
        data, r = (h or "").encode(), got[i]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
    assert warc.warc_round_trip(pages(spark, [])).count() == 0


def test_warc_with_many_false_headers(spark, monkeypatch):
    """Payloads full of record headers, in chains of their own, verified by joins, and records over many buckets."""
    monkeypatch.setattr(warc, "CANDIDATES", 20)
    monkeypatch.setattr(warc, "BUCKET", 500)
    fake = "".join(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" for k in range(70))
    rows = [(k, "u", f"{fake}{k}" if k % 3 == 0 else "WARC/1.0\r\n" * k) for k in range(30)]
    got = {r["page_id"]: r for r in warc.warc_round_trip(pages(spark, rows).coalesce(2)).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        assert got[i]["payload_bytes"] == len(h) and got[i]["record_type"] == "response"
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()


def test_warc_minimum(spark):
    got = {r["page_id"]: r["record_type"] for r in warc.warc_round_trip(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_pointer_jumping():
    start = np.array([10, 20, 25, 40, 90])
    follows = np.array([40, 90, 40, 77, 10])
    assert warc.reachable(start, follows, 10).tolist() == [True, False, False, True, False]
    n = 1000
    assert warc.reachable(np.arange(n) * 7 + 10, np.arange(1, n + 1) * 7 + 10, 10).all()
    assert not warc.reachable(np.zeros(0, np.int64), np.zeros(0, np.int64), 10).any()


def test_base32(spark):
    data = [b"", b"a", b"hello", bytes(range(256))]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, b binary").orderBy("i").select(warc.base32_sha1(F.col("b"))).collect()
    assert [r[0] for r in got] == [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in data]
