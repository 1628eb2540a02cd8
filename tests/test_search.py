"""Search, lines, index, overlay, streaming, files and stores on small fixtures."""

import io
import random

import pytest
from pyspark.sql import functions as F

from trawl import cli
from trawl.model import CHANGES, FILES, Case, Layers, Options, PathMode, SearchRequest, Sort
from trawl.operators import index, lines, overlay
from trawl.operators.batch import search_batch
from trawl.operators.search import Indexed, count_results, indexed_search, search
from trawl.sources import files as files_module
from trawl.sources import walk as walk_module
from trawl.sources.build import build, build_if_missing, is_stale, report_frame, safety_net, spawn_build, spawn_if_missing
from trawl.sources.files import build_report, direct_scan, scan
from trawl.sources.store import Database, FileStore, Registry, Settings, SnapshotStore, status
from trawl.sources.walk import walk
from trawl.streaming import changes as streams


def table(spark, contents, db="d"):
    rows = [(db, p, False, len(c) if c else 0, 100 + i, c) for i, (p, c) in enumerate(contents.items())]
    return spark.createDataFrame(rows, FILES)


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def find(df, query, scope=None, limit=None, db=None, **opts):
    return paths(search(df, SearchRequest(query, scope, limit, db, Options(**opts))))


def test_paths_and_limits(spark):
    files = table(spark, {f"/users/x/docs/file_{i:03}.txt": None for i in range(100)} | {"/users/x/downloads/report.pdf": None})
    assert len(find(files, "file_04")) == 10 and len(find(files, "report")) == 1
    assert len(find(files, "file", limit=3)) == 3 and find(files, "file", limit=0) == [] and find(files, "") == []


def test_case_and_cjk(spark):
    files = table(spark, {"/m/Foo.txt": None, "/m/foo.txt": None, "/m/FOO.txt": None, "/m/bar.txt": None, "/x/下载/安全浏览器.app": None})
    assert len(find(files, "Foo")) == 1 and len(find(files, "Foo", case=Case.INSENSITIVE)) == 3 and len(find(files, "fo")) == 3
    assert len(find(files, "安全")) == len(find(files, "下载")) == 1


def test_boolean(spark):
    files = table(spark, dict.fromkeys(["/proj/src/main.rs", "/proj/src/main_test.rs", "/proj/docs/readme.md", "/proj/build/out.bin", "/other/main.go"]))
    one = ["/proj/src/main_test.rs"]
    assert find(files, "main AND test", case=Case.INSENSITIVE) == find(files, "main test") == one
    assert len(find(files, "readme OR go", case=Case.INSENSITIVE)) == 2
    assert find(files, "(readme OR go) AND NOT main", case=Case.INSENSITIVE) == ["/proj/docs/readme.md"]
    assert find(files, "(readme)", case=Case.INSENSITIVE) == ["/proj/docs/readme.md"] and find(files, "(readme)", raw=True) == []


def test_kinds_layers_sort(spark):
    files = table(spark, {"alpha.rs": "fn alpha() {}", "beta.rs": "// alpha mention\n", "other.txt": None, "zfile.txt": "needle here\n", "aneedle.txt": "no\n"})
    got = {r["path"]: r["kind"] for r in search(files, SearchRequest("alpha")).collect()}
    assert got == {"alpha.rs": "both", "beta.rs": "content"}
    assert find(files, "alpha", layers=Layers.FILENAME) == ["alpha.rs"] and len(find(files, "alpha", layers=Layers.CONTENT)) == 2
    assert [r["path"] for r in search(files, SearchRequest("needle")).collect()] == ["zfile.txt", "aneedle.txt"]
    assert [r["path"] for r in search(files, SearchRequest("needle", opts=Options(sort=Sort.PATH))).collect()] == ["aneedle.txt", "zfile.txt"]
    assert count_results(files, SearchRequest("alpha", limit=1)).first()["total"] == 1


def test_content_case(spark):
    files = table(spark, {"a": "fn FooBar() {}", "b": "fn foobar() {}", "c": "fn FOOBAZ() {}", "d": "É", "e": "é"})
    assert find(files, "FooBar") == ["a"] and find(files, "FooBar", case=Case.INSENSITIVE) == ["a", "b"]
    assert find(files, "É") == ["e"] and find(files, "obar") == ["a", "b"]


def test_regex_and_scope(spark):
    files = table(spark, {"src/a": "fn main() { }", "docs/b": "async fn main() -> u32 { 0 }", "src/c": "struct Foo; // no main here", "sub/x.txt": None, "sub.txt": None})
    assert find(files, "fn.*main", regex=True) == ["docs/b", "src/a"] and find(files, "fn.*main", scope="src", regex=True) == ["src/a"]
    assert find(files, "sub") == ["sub.txt", "sub/x.txt"] and find(files, "sub", path_mode=PathMode.BASENAME) == ["sub.txt"]
    with pytest.raises(ValueError):
        find(files, "(", regex=True)


def test_databases(spark):
    both = table(spark, {"shared.txt": "needle", "one.txt": "needle"}, "r1").unionByName(table(spark, {"shared.txt": None, "needle.txt": None}, "r2"))
    assert find(both, "needle") == ["needle.txt", "one.txt", "shared.txt"] and find(both, "needle", db="r2") == ["needle.txt"]
    with pytest.raises(ValueError, match="r1, r2"):
        find(both, "needle", db="nope")
    assert search(both, SearchRequest("shared")).collect()[0]["size"] == 6


def test_what_the_first_file_of_a_path_lacks(spark):
    """It is taken from the next database's, or from another file of the same one; files that lack nothing are told of whole."""
    files = [
        ("r1", "needle_a", False, None, 5, None), ("r2", "needle_a", False, 7, 9, None),
        ("r1", "needle_b", False, None, 1, None), ("r1", "needle_b", False, 4, 8, None), ("r1", "needle_b", False, 3, None, None),
        ("r1", "needle_c", False, 3, None, None), ("r2", "needle_c", False, 2, None, None),
    ]
    got = {r["path"]: (r["size"], r["mtime"]) for r in search(spark.createDataFrame(files, FILES), SearchRequest("needle")).collect()}
    assert got == {"needle_a": (7, 5), "needle_b": (4, 8), "needle_c": (3, None)}


def test_expression_errors(spark):
    with pytest.raises(ValueError):
        find(table(spark, {"a": None}), "a", expr="-bad x")


BODY = "alpha\nbeta\nGAMMA\ndelta\nepsilon\n"


def _block(content, at, n):
    """The context block of a match by hand: (first line, text)."""
    parts = content.splitlines(keepends=True)
    line = content[:at].count("\n")
    first = max(0, line - n)
    return first + 1, "".join(parts[first : line + n + 1])


def test_lines_and_context(spark):
    files = table(spark, {"f": BODY, "g": "x gamma", "h": None})
    hits = lambda q, c=None, **o: sorted((r["path"], r["line_no"], r["text"]) for r in lines.search_lines(files, SearchRequest(q, opts=Options(**o)), c).collect())
    assert hits("gamma") == [("f", 3, "GAMMA"), ("g", 1, "x gamma")] and hits("GAMMA") == [("f", 3, "GAMMA")]
    assert hits("GAMMA", 1) == [("f", 2, "beta\nGAMMA\ndelta\n")] and hits("alpha", 1) == [("f", 1, "alpha\nbeta\n")]
    assert hits("a\nb") == [("f", 1, "alpha")] and hits("^alpha", regex=True) == [("f", 1, "alpha")] and hits("^beta", regex=True) == []
    assert hits("a", 2)[0][1] == 1
    shown = [r["rendered"] for r in lines.render(lines.search_lines(files, SearchRequest("GAMMA"), 1), True).orderBy("line_no").collect()]
    assert shown == ["f-2:beta", "f-3:GAMMA", "f-4:delta"]


def test_context_against_brute_force(spark):
    rng = random.Random(9)
    for _ in range(4):
        contents = {f"p{k}": "".join(rng.choice("ab\n") for _ in range(rng.randint(1, 30))) for k in range(25)}
        n = rng.randint(0, 2)
        got = sorted((r["path"], r["line_no"], r["text"]) for r in lines.search_lines(table(spark, contents), SearchRequest("ab"), n).collect())
        want = set()
        for p, c in contents.items():
            seen, at = set(), c.find("ab")
            while at >= 0:
                first, body = _block(c, at, n)
                if first not in seen:
                    seen.add(first)
                    want.add((p, first, body))
                at = c.find("ab", at + 2)
        assert got == sorted(want)


def test_index_equals_scan(spark):
    rng = random.Random(4)
    contents = {f"p{k}": "".join(rng.choice("abcAé ") for _ in range(rng.randint(0, 40))) for k in range(60)}
    files = table(spark, contents)
    postings = index.content_postings(files).cache()
    fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    for needle in ["abc", "ab", "a", "é a", "caA", "zzz", "aé", "abca"]:
        want = sorted(p for p, c in contents.items() if fold(needle) in fold(c))
        assert paths(index.index_search(files, postings, needle)) == want == find(files, needle, layers=Layers.CONTENT, case=Case.INSENSITIVE)
    assert paths(index.index_search(table(spark, {"a": "foobar", "b": "foobaz"}), index.content_postings(table(spark, {"a": "foobar", "b": "foobaz"})), "foobaz")) == ["b"]
    assert index.rarest_trigram(postings, "zzz").first()["df"] == 0


def log(spark, rows):
    return spark.createDataFrame([(i, op, p, False, len(c or ""), i, c) for i, (op, p, c) in enumerate(rows)], CHANGES)


def test_overlay(spark):
    cold = table(spark, {"a": "old", "b": "cold", "dir/x": "deep", "k": "kept"})
    changes = log(spark, [("upsert", "a", "one"), ("upsert", "a", "two"), ("delete", "b", None), ("delete", "c", None), ("upsert", "c", "again"), ("delete", "dir", None)])
    got = {r["path"]: r["content"] for r in overlay.merged(cold, changes, db="d").collect()}
    assert got == {"a": "two", "c": "again", "dir/x": "deep", "k": "kept"}
    assert "dir/x" not in paths(overlay.merged(cold, changes, db="d", subtrees=True))
    assert overlay.overlay_length(changes).first()["paths"] == 4 and overlay.needs_compaction(changes, 4)


def test_stream_equals_batch_and_compacts(spark, tmp_path):
    cold = table(spark, {f"p{k}": "cold" for k in range(6)})
    rng = random.Random(1)
    rows = [(rng.choice(["upsert", "upsert", "delete"]), f"p{rng.randint(0, 9)}", f"v{k}") for k in range(60)]
    changes = log(spark, rows)
    for part in range(3):  # files hold interleaved numbers
        streams.append_log(changes.filter(F.col("seq") % 3 == part).coalesce(1), f"{tmp_path}/log")
    state = streams.latest_of_stream(spark, f"{tmp_path}/log", f"{tmp_path}/over")
    want = {r["path"]: (r["op"], r["content"]) for r in overlay.latest(changes).collect()}
    assert {r["path"]: (r["op"], r["content"]) for r in state.collect()} == want
    over, store = streams.Overlay(spark, f"{tmp_path}/over"), SnapshotStore(spark, f"{tmp_path}/cold")
    store.publish(cold)
    pinned = store.snapshot()
    before = {r["path"]: r["content"] for r in streams.current(over, pinned).collect()}
    assert store.lock() and streams.compact(spark, over, store) is None
    store.unlock()
    assert streams.compact(spark, over, store) and over.state().count() == 0
    assert {r["path"]: r["content"] for r in store.snapshot().collect()} == before
    assert pinned.count() == 6
    over.apply(changes.limit(5), 99)  # replayed changes stay cut off
    assert over.state().count() == 0
    over.apply(spark.createDataFrame([(1000, "upsert", "new", False, 1, 1, "x")], CHANGES), 100)
    assert paths(over.state()) == ["new"]


def tree(root):
    for name, data in {"a.rs": b"fn main() {}\n", "bin.dat": b"ab\0c", "big.txt": b"x" * 100, "noise.log": b"n", "secret/hidden.rs": b"s", "node_modules/pkg/i.js": b"j", ".git/config": b"g", "sub/b.md": "# é\nmain\n".encode(), "sub/.gitignore": b"*.tmp\n", "sub/x.tmp": b"t", "sub/__init__.py": b"i = 1\n"}.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)


def test_scan(spark, tmp_path):
    tree(tmp_path)
    found = scan(spark, str(tmp_path), cap=50, ignore=["*.log", f"{tmp_path}/secret"])
    got = {r["path"][len(str(tmp_path)) + 1 :]: (r["gate"], r["content"], r["is_dir"]) for r in found.collect()}
    assert got == {"a.rs": ("text", "fn main() {}\n", False), "bin.dat": ("binary", None, False), "big.txt": ("large", None, False), "sub/b.md": ("text", "# é\nmain\n", False), "sub": (None, None, True), "sub/__init__.py": ("text", "i = 1\n", False)}
    report = build_report(found).first()
    assert (report["filename_docs"], report["content_docs"], report["skipped_binary"], report["skipped_large"]) == (6, 3, 1, 1)
    assert find(found, "main") == [f"{tmp_path}/a.rs", f"{tmp_path}/sub/b.md"]
    assert paths(direct_scan(spark, str(tmp_path), "hidden")) == [f"{tmp_path}/secret/hidden.rs"] == paths(direct_scan(spark, str(tmp_path), "HIDDEN", Options(case=Case.INSENSITIVE)))
    assert paths(direct_scan(spark, str(tmp_path), "HIDDEN")) == [] and paths(direct_scan(spark, str(tmp_path), "i.js")) == [f"{tmp_path}/node_modules/pkg/i.js"]
    assert paths(direct_scan(spark, str(tmp_path), "s", ignore=["secret", "pkg"], scope=f"{tmp_path}/node_modules")) == [f"{tmp_path}/node_modules"]


def test_records_of_touched_files(spark, tmp_path):
    tree(tmp_path)
    names = ["a.rs", "bin.dat", "big.txt", "gone.txt", "sub"]
    touched = spark.createDataFrame([(k, f"{tmp_path}/{n}") for k, n in enumerate(names)], "seq int, path string")
    got = {r["path"].rpartition("/")[2]: (r["op"], r["is_dir"], r["content"]) for r in streams.records_of(touched, str(tmp_path), cap=50).collect()}
    assert got == {"a.rs": ("upsert", False, "fn main() {}\n"), "bin.dat": ("upsert", False, None), "big.txt": ("upsert", False, None), "gone.txt": ("delete", False, None), "sub": ("upsert", True, None)}


def test_json_log_is_cut_at_damage(spark, tmp_path):
    good = '{"seq": %d, "op": "upsert", "path": "p%d", "is_dir": false, "size": 1, "mtime": 1, "content": "x"}\n'
    (tmp_path / "one.json").write_text(good % (1, 1) + good % (2, 2) + (good % (3, 3))[:-30] + "\n" + good % (4, 4))
    (tmp_path / "two.json").write_text(good % (5, 5))
    assert paths(streams.read_json_log(spark, str(tmp_path))) == ["p1", "p2", "p5"]


def test_build(spark, tmp_path):
    tree(tmp_path / "t")
    store = SnapshotStore(spark, f"{tmp_path}/s")
    made = build(spark, str(tmp_path / "t"), store, cap=50)
    assert (made["filename_docs"], made["skipped_binary"], made["skipped_large"]) == (9, 1, 1) and report_frame(spark, made).first()["content_docs"] == made["content_docs"]
    assert build(spark, str(tmp_path / "t"), store)["version"] == made["version"]  # still fresh
    assert build_if_missing(spark, "/nowhere", store)["version"] == made["version"]
    assert not is_stale(store) and is_stale(store, now=made["build_time"] + 8 * 86_400)
    assert store.lock() and build(spark, str(tmp_path / "t"), store, force=True) is None


def test_registry_settings_status(spark, tmp_path):
    store = FileStore(spark)
    r = Registry.load(store, f"{tmp_path}/r.json")
    r.upsert(Database("a", "/a", f"{tmp_path}/a"))
    r.upsert(Database("a", "/b", f"{tmp_path}/a"))
    r.save(store, f"{tmp_path}/r.json")
    assert Registry.load(store, f"{tmp_path}/r.json").get("a").root == "/b" and r.remove("a") and not r.remove("a")
    (tmp_path / "s.json").write_text('{"ignore": ["x"], "later": 1}')
    s = Settings.load(store, f"{tmp_path}/s.json")
    assert s.ignore == ["x"] and s.add("y") and not s.add("y") and s.remove("x") and not s.remove("x")
    (tmp_path / "bad.json").write_text("{")
    assert Settings.load(store, f"{tmp_path}/bad.json").ignore == []
    assert status(spark, [Database("a", "/a", f"{tmp_path}/a")]).first()["state"] == "missing"


def test_cli(spark, tmp_path):
    tree(tmp_path / "t")

    def run(*args):
        out = io.StringIO()
        cli.main(["--home", str(tmp_path / "home"), *args], spark, out)
        return out.getvalue()

    run("config", "add", "*.log")
    run("index", str(tmp_path / "t"), "--name", "t")
    assert run("search", "main", "--count") == "2\n" and run("search", "main", "-n", "-e", "md").endswith("sub/b.md:2:main\n")
    assert "[c]\t" in run("search", "main", "-l") and "noise.log" not in run("search", "noise")
    assert run("status").strip().endswith("fresh")
    assert run("db", "list").startswith("t\t")
    assert run("search", "main", "--direct", "--count") == "0\n" and run("search", "b.md", "--direct", "--limit", "1").endswith("sub/b.md\n")


def odd_bytes(root):
    """Files that are not UTF-8, beside one that is."""
    root.mkdir(parents=True, exist_ok=True)
    for name, data in {"ok.txt": "é needle\n".encode(), "latin.txt": "caf\xe9 needle\n".encode("latin-1"), "cut.txt": "needle 日本".encode()[:-1], "pic.png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR", "short.png": b"\x89PNG\r\n\x1a", "utf16.txt": "needle".encode("utf-16"), "empty.txt": b""}.items():
        (root / name).write_bytes(data)


def test_files_that_are_not_utf8(spark, tmp_path):
    odd_bytes(tmp_path)
    found = {r["path"].rpartition("/")[2]: (r["gate"], r["content"]) for r in scan(spark, str(tmp_path)).collect()}
    assert found["ok.txt"] == ("text", "é needle\n") and found["latin.txt"] == ("text", "caf� needle\n")
    assert found["cut.txt"] == ("text", "needle 日本".encode()[:-1].decode("utf-8", "replace")) and found["short.png"] == ("text", b"\x89PNG\r\n\x1a".decode("utf-8", "replace"))
    assert found["pic.png"] == ("binary", None) and found["utf16.txt"] == ("binary", None) and found["empty.txt"] == ("text", "")
    assert [p.rpartition("/")[2] for p in find(scan(spark, str(tmp_path)), "needle", layers=Layers.CONTENT)] == ["cut.txt", "latin.txt", "ok.txt"]
    made = build(spark, str(tmp_path), SnapshotStore(spark, f"{tmp_path}/../s_{tmp_path.name}"), index=True)
    assert (made["content_docs"], made["skipped_binary"], made["denied"]) == (5, 2, 0)
    touched = spark.createDataFrame([(k, str(p)) for k, p in enumerate(sorted(tmp_path.iterdir()))], "seq int, path string")
    got = {r["path"].rpartition("/")[2]: r["content"] for r in streams.records_of(touched, str(tmp_path)).collect()}
    assert got == {k: v[1] for k, v in found.items()}


def test_cli_on_files_that_are_not_utf8(spark, tmp_path):
    odd_bytes(tmp_path / "t")

    def run(*args):
        out = io.StringIO()
        cli.main(["--home", str(tmp_path / "home"), *args], spark, out)
        return out.getvalue()

    run("index", str(tmp_path / "t"), "--name", "t")
    assert run("search", "needle", "--content", "--count") == "3\n" and run("search", "NEEDLE", "-i", "--count") == "3\n"
    assert run("search", "needle", "-n", "-e", "txt").count("needle") == 3
    (tmp_path / "t" / "new.txt").write_text("needle too")
    (tmp_path / "t" / "latin.txt").unlink()
    assert run("update", "t") == "2 changed paths\n"
    assert run("search", "needle", "--content").split() == [f"{tmp_path}/t/{n}.txt" for n in ("cut", "new", "ok")]
    assert run("update", "t") == "2 changed paths\n"  # nothing new


def test_walk_prunes_and_counts(spark, tmp_path):
    tree(tmp_path)
    for k in range(30):
        (tmp_path / f"deep/{'/'.join('abcdefg'[: k % 7 + 1])}/n{k}").mkdir(parents=True)
    (tmp_path / "deep/a/.gitignore").write_text("b/\n!keep.txt\n*.txt\n")
    (tmp_path / "deep/a/keep.txt").write_text("x")
    (tmp_path / "deep/a/n0/keep.txt").write_text("x")
    (tmp_path / "_odd=1").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path)
    rows = walk(spark, str(tmp_path)).collect()
    names = sorted(r["path"][len(str(tmp_path)) + 1 :] for r in rows)
    assert len(names) == len(set(names)) and "_odd=1" in names and "link" in names and not any(n.startswith("link/") for n in names)
    assert "node_modules" not in names and ".git" not in names and "deep/a" in names and "deep/a/b" not in names and "deep/a/keep.txt" not in names
    assert ".git/config" in [r["path"][len(str(tmp_path)) + 1 :] for r in walk(spark, str(tmp_path), hidden=True, use_ignore_files=False).collect()]


def test_walk_hands_directories_back(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"d{k % 5}/e{k % 8}/f{k}").mkdir(parents=True)
        (tmp_path / f"d{k % 5}/e{k % 8}/f{k}/x.txt").write_text("x")
    (tmp_path / ".gitignore").write_text("f7\n")
    whole = sorted(map(str, walk(spark, str(tmp_path)).collect()))
    monkeypatch.setattr("trawl.sources.walk.DIRECTORIES", 3)
    run = walk_module._walk(str(tmp_path), frozenset(walk_module.SKIP_DIRS), (), False, True)
    import pyarrow as pa

    waiting, seen = [(str(tmp_path), "[]")], []
    while waiting:  # the rounds by hand: workers have the module's own number
        batch = pa.RecordBatch.from_arrays([pa.array([w[0] for w in waiting]), pa.array([w[1] for w in waiting])], ["path", "rules"])
        rows = [r for b in run(iter([batch])) for r in b.to_pylist()]
        waiting = [(r["path"], r["rules"]) for r in rows if r["denied"] is None]
        seen += [r["path"] for r in rows if r["denied"] is False]
    assert sorted(seen) == sorted(r["path"] for r in walk(spark, str(tmp_path)).collect()) and len(whole) == len(seen)


def test_denied_directories_are_counted(spark, tmp_path, monkeypatch):
    run = walk_module._walk(str(tmp_path), frozenset(), (), False, True)
    (tmp_path / "shut").mkdir()
    real = walk_module._entries

    def entries(store, path):
        if path.endswith("shut"):
            raise PermissionError(path)
        return real(store, path)

    monkeypatch.setattr(walk_module, "_entries", entries)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([str(tmp_path)]), pa.array(["[]"])], ["path", "rules"])
    rows = [r for b in run(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["path"].rpartition("/")[2], r["denied"]) for r in rows) == [("shut", False), ("shut", True)]


def test_late_changes_after_a_compaction(spark, tmp_path):
    over, store = streams.Overlay(spark, f"{tmp_path}/over"), SnapshotStore(spark, f"{tmp_path}/cold")
    store.publish(table(spark, {"a": "cold", "b": "cold", "c": "cold"}))
    change = lambda *rows: spark.createDataFrame([(s, op, p, False, 1, s, c) for s, op, p, c in rows], CHANGES)
    over.apply(change((10, "upsert", "a", "ten"), (11, "delete", "b", None)), 0)
    assert streams.compact(spark, over, store)
    over.apply(change((5, "upsert", "late", "five"), (6, "upsert", "a", "six"), (7, "upsert", "b", "seven"), (9, "upsert", "c", "nine")), 1)
    view = {r["path"]: r["content"] for r in streams.current(over, store.snapshot()).collect()}
    assert view == {"a": "ten", "c": "nine", "late": "five"}
    # a batch that comes while a compaction runs stays
    p = over.pointer()
    over.apply(change((20, "upsert", "meanwhile", "x")), 2)
    over.clear(p)
    assert paths(over.state()) == ["meanwhile"]


def test_deltas_are_folded_and_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FOLD_AT", 4)
    over, want = streams.Overlay(spark, f"{tmp_path}/over"), {}
    for k in range(11):
        rows = [(k * 10 + j, "upsert", f"p{(k + j) % 5}", False, 1, 1, f"{k}.{j}") for j in range(3)]
        over.apply(spark.createDataFrame(rows, CHANGES), k)
        want |= {r[2]: r[6] for r in rows}
    assert {r["path"]: r["content"] for r in over.state().collect()} == want and len(over.pointer()["deltas"]) < 4
    kept = [f for f in over.files.folders(over.root)]
    assert len(kept) <= 2 * 4 + 1  # the deltas in use and those of the fold before


def test_old_versions_are_removed(spark, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/s")
    made = [store.publish(table(spark, {f"f{k}": "x"})) for k in range(4)]
    there = {f.rpartition("/")[2] for f in store.files.folders(store.root)}
    assert there == {m["version"].rpartition("/")[2] for m in made[-2:]} and paths(store.snapshot()) == ["f3"]


def test_capture_equals_a_new_scan(spark, tmp_path):
    root = tmp_path / "t"
    tree(root)
    store, log = SnapshotStore(spark, f"{tmp_path}/s"), f"{root}/data/log"
    build(spark, str(root), store)
    over = streams.Overlay(spark, f"{tmp_path}/over")
    (root / "a.rs").write_text("fn other() {}\n")
    (root / "sub/b.md").unlink()
    (root / "fresh").mkdir()
    (root / "fresh/x.txt").write_bytes(b"caf\xe9")
    for _ in range(2):  # the log lies in the tree: what it holds is no change
        streams.capture(spark, str(root), streams.current(over, store.snapshot().drop("gate")), log, own=(f"{root}/data",))
        streams.watch(spark, log, f"{tmp_path}/over", once=True).awaitTermination()
        view = {r["path"]: r["content"] for r in streams.current(over, store.snapshot().drop("gate")).filter(~F.col("path").startswith(f"{root}/data")).collect()}
        again = {r["path"]: r["content"] for r in scan(spark, str(root), ignore=[f"{root}/data"]).collect()}
        assert {k: v for k, v in view.items() if not k.endswith(("/sub", "/fresh"))} == {k: v for k, v in again.items() if not k.endswith(("/sub", "/fresh"))}
    assert streams.read_changes and spark.read.parquet(log).filter(F.col("path").contains("/data/")).count() == 0
    assert streams.compact(spark, over, store) and find(store.snapshot(), "other", layers=Layers.CONTENT) == [f"{root}/a.rs"]


def test_background_build(spark, tmp_path):
    tree(tmp_path / "t")
    store = SnapshotStore(spark, f"{tmp_path}/s")
    job = spawn_if_missing(spark, str(tmp_path / "t"), store, cap=50)
    assert job.result(120)["filename_docs"] == 9 and job.done() and spawn_if_missing(spark, str(tmp_path / "t"), store) is None
    assert store.lock() and spawn_build(spark, str(tmp_path / "t"), store) is None
    store.unlock()
    with pytest.raises(Exception):  # noqa: B017
        spawn_build(spark, str(tmp_path / "t"), SnapshotStore(spark, f"{tmp_path}/u"), nonsense=1).result(60)


def test_written_index_equals_scan(spark, tmp_path):
    rng = random.Random(14)
    contents = {f"p{k}": None if k % 9 == 0 else "".join(rng.choice("abcAé ") for _ in range(rng.randint(0, 40))) for k in range(80)}
    files = table(spark, contents)
    written = index.ContentIndex.build(files.repartition(3), f"{tmp_path}/i")
    plain = index.content_postings(files).cache()
    for needle in ["abc", "ab", "a", "é a", "caA", "zzz", "aé", "abca", "Abc", "", "p1"]:
        for case in (Case.INSENSITIVE, Case.SENSITIVE):
            want = find(files, needle, layers=Layers.CONTENT, case=case)
            assert paths(written.search(needle, case is Case.SENSITIVE)) == want
            for layers in (Layers.CONTENT, Layers.BOTH):
                request = SearchRequest(needle, opts=Options(layers=layers, case=case))
                assert [tuple(r) for r in indexed_search([Indexed('d', written)], request).collect()] == [tuple(r) for r in search(files, request).collect()]
        if len(needle.encode()) >= 3:
            assert paths(written.candidates(needle)) == paths(index.candidates(plain, needle))
            assert written.rarest_trigram(needle).first() == index.rarest_trigram(plain, needle).first()
    assert sorted(map(tuple, written.frequencies().collect())) == sorted(map(tuple, index.document_frequencies(plain).collect()))
    plan = written._rows(["616263"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(trigram" in plan.replace("In(trigram", "EqualTo(trigram")


def test_many_candidates_meet_in_a_join(spark, tmp_path, monkeypatch):
    files = table(spark, {f"p{k}": f"{'some longer needle' if k % 3 else 'other'} {k}" for k in range(90)})
    written = index.ContentIndex.build(files, f"{tmp_path}/i")
    few = paths(written.search("some longer needle 1"))
    for name in ("LISTED", "LOOKED_UP"):
        monkeypatch.setattr(index, name, 3)
        assert paths(written.search("some longer needle 1")) == few == find(files, "some longer needle 1", layers=Layers.CONTENT)
        assert len(paths(written.search("needle"))) == 60 and paths(written.search("no such needle")) == []


def test_indexes_under_overlays_of_several_databases(spark, tmp_path):
    rng = random.Random(17)
    word = lambda: rng.choice(["needle", "Needle", "hay", "xneedley", "é"])
    databases, merged = [], None
    for db in ("r1", "r2"):
        cold = table(spark, {f"{rng.choice(['needle', 'dir'])}/p{k}": word() for k in range(25)}, db)
        rows = [(k, rng.choice(["upsert", "upsert", "delete"]), p, False, 5, k, rng.choice([word(), None])) for k, p in enumerate([r["path"] for r in cold.limit(8).collect()] + [f"new/{db}needle", "new/both"])]
        changes = spark.createDataFrame(rows, CHANGES) if db == "r1" else None
        databases.append(Indexed(db, index.ContentIndex.build(cold, f"{tmp_path}/{db}"), changes))
        files = overlay.merged(cold, changes, db=db) if changes is not None else cold
        merged = files if merged is None else merged.unionByName(files)
    for request in (SearchRequest("needle"), SearchRequest("Needle", opts=Options(layers=Layers.CONTENT)), SearchRequest("needle", scope="dir", limit=7), SearchRequest("needle", db="r2"), SearchRequest("ne"), SearchRequest("n[e]+dle", opts=Options(regex=True)), SearchRequest("needle", opts=Options(expr="-newer dir/p1 -o -size -6c"))):
        assert [tuple(r) for r in indexed_search(databases, request).collect()] == [tuple(r) for r in search(merged, request).collect()], request
    with pytest.raises(ValueError, match="r1, r2"):
        indexed_search(databases, SearchRequest("needle", db="nope"))


def test_batch_equals_single_searches(spark):
    rng = random.Random(15)
    files = table(spark, {"/" + "".join(rng.choice("abcAB/.éΣ_") for _ in range(rng.randint(1, 14))) + str(k): None for k in range(120)})
    queries = ["a", "ab", "A", "é", "aB", "/a", "1", "12", "b/c", "Σ", "nothing here", "", "_", "a.b", ".A"] + ["".join(rng.choice("abcAB/") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    got = {}
    for r in search_batch(files, queries).collect():
        got.setdefault(r["query"], []).append(r["path"])
    for q in set(queries):
        assert sorted(got.get(q, [])) == find(files, q, layers=Layers.FILENAME, raw=True), q
    assert search_batch(files, []).count() == 0


def test_match_offsets(spark):
    files = table(spark, {"a": "éAbab ab", "b": None, "c": "aaaa", "d": ""})
    got = lambda q, s=False: sorted((r["path"], r["byte_offset"]) for r in lines.match_offsets(files, q, s).collect())
    assert got("ab") == [("a", 2), ("a", 4), ("a", 7)] and got("ab", True) == [("a", 4), ("a", 7)] and got("aa") == [("c", 0), ("c", 2)] and got("") == []


def test_literal_atoms_change_nothing(spark):
    rng = random.Random(16)
    files = table(spark, {f"p{k}": "".join(rng.choice("abkKKiİ. \n") for _ in range(rng.randint(0, 12))) for k in range(150)})
    from trawl.functions.patterns import java_regex

    for pattern in ("abb?", "a+bb", "abk", "[ab]aba", "ab.ba", "bab{2}", r"\bab", "aba*b", "bka", "a b", r"ab\.", "^abb", "aib"):
        for sensitive in (True, False):
            want = sorted(r["path"] for r in files.filter(F.col("content").rlike(java_regex(pattern, sensitive))).collect())
            assert find(files, pattern, layers=Layers.CONTENT, regex=True, case=Case.SENSITIVE if sensitive else Case.INSENSITIVE) == want, pattern


def test_scan_through_sparks_reader(spark, tmp_path):
    """What a store gives that only Spark's readers can open: the same but for empty files and names with a leading dot
    or underscore."""
    tree(tmp_path)
    odd_bytes(tmp_path / "odd")
    ignore = ["*.log", "secret", "*.tmp"]
    got = files_module._by_reader(spark, str(tmp_path), 50, (), ignore, False, True)
    key = lambda df: {r["path"]: (r["gate"], r["content"]) for r in df.collect() if not r["is_dir"] and "__init__" not in r["path"] and r["size"]}
    assert key(got) == key(scan(spark, str(tmp_path), cap=50, ignore=ignore)) and not files_module.is_walkable("nosuchstore://x/y")
    names = files_module._by_reader(spark, str(tmp_path), 50, (), ignore, False, False)
    assert sorted(paths(names)) == sorted(paths(got))


def test_safety_net_rebuilds(spark, tmp_path):
    tree(tmp_path / "t")
    store, rounds = SnapshotStore(spark, f"{tmp_path}/s"), iter([False, False, True, True, True, True])
    safety_net(spark, str(tmp_path / "t"), store, every=0, stop=lambda: next(rounds))
    first = store.manifest()
    assert first["filename_docs"] == 9 and store.snapshot().count() == first["docs"]


def test_watching_in_intervals(spark, tmp_path):
    """The stream with its debounce interval takes up what is added while it runs; skipped and ignored paths stay out."""
    import time

    log, over = f"{tmp_path}/log", streams.Overlay(spark, f"{tmp_path}/over")
    change = lambda *rows: spark.createDataFrame([(s, "upsert", p, False, 1, s, "x") for s, p in rows], CHANGES)
    streams.append_log(change((1, "/a"), (2, "/node_modules/b"), (3, "/noise.log")), log)
    rules = lambda: files_module.compile_ignores(["*.log"], "/")
    query = streams.watch(spark, log, f"{tmp_path}/over", rules=rules)
    try:
        for more, want in ((None, ["/a"]), ((4, "/c"), ["/a", "/c"])):
            if more:
                streams.append_log(change(more), log)
            until = time.time() + 60
            while paths(over.state()) != want and time.time() < until:
                time.sleep(0.2)
            assert paths(over.state()) == want
    finally:
        query.stop()
