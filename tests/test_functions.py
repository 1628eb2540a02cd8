"""Pure-Python parts: parsers, patterns, smart case, and their Columns on literal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from trawl.functions import display, text
from trawl.functions.patterns import glob_match, glob_regex, ignore_rule, ignored, java_regex
from trawl.model import Case
from trawl.operators.filters import TYPES, in_scope, type_extensions
from trawl.plans import boolquery, findexpr


def values(spark, column, rows, name="path"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, {name} string").orderBy("i").select(column).collect()]


def test_smart_case():
    for q, sensitive in (("foo", False), ("main.rs", False), ("Foo", True), ("README", True), ("index.MD", True), (r"\W", True), ("É", False)):
        assert Case.SMART.sensitive(q) is sensitive
    assert not Case.INSENSITIVE.sensitive("Foo") and Case.SENSITIVE.sensitive("foo")


def test_boolean_parser():
    same = [("a b", "a AND b"), ("a OR b c", "a OR (b AND c)"), ("NOT a b", "(NOT a) AND b"), ("((a))", "a"), ("a NOT b", "a AND (NOT b)")]
    for x, y in same:
        assert boolquery.parse(x) == boolquery.parse(y) is not None
    for bad in ("", "AND", "a AND", "a OR", "(a", "a)", "NOT", "()", "a AND OR b"):
        assert boolquery.parse(bad) is None
    assert boolquery.parse("and or") == boolquery.Both(boolquery.Term("and"), boolquery.Term("or"))


def _random_tree(rng, depth=0):
    kind = rng.choice(["t", "t", "n", "b", "e"]) if depth < 4 else "t"
    if kind == "t":
        return boolquery.Term(rng.choice(["x", "note", "a.b", "and"]))
    if kind == "n":
        return boolquery.Not(_random_tree(rng, depth + 1))
    return (boolquery.Both if kind == "b" else boolquery.Either)(_random_tree(rng, depth + 1), _random_tree(rng, depth + 1))


def test_boolean_round_trip():
    rng = random.Random(5)
    for _ in range(500):
        tree = _random_tree(rng)
        assert boolquery.parse(tree.text()) == tree


def test_find_expression_parser():
    t = findexpr.Test
    assert findexpr.parse("-name a -size +1k") == findexpr.Node("and", (t("name", "a"), t("size", "+1k")))
    assert findexpr.parse("-name 'a' -o ! -path \"b\"") == findexpr.Node("or", (t("name", "a"), findexpr.Node("not", (t("path", "b"),))))
    for bad in ("", "-name", "-size x", "-foo a", "( -name a", "-name a )", "-name a b", "-size 1q"):
        with pytest.raises(ValueError):
            findexpr.parse(bad)
    assert findexpr.parse_size("+100c") == (">", 100) and findexpr.parse_size("-1k") == ("<", 1024) and findexpr.parse_size("9999999999G")[1] == 2**63 - 1


def test_find_expression_values(spark):
    df = spark.createDataFrame([("/a/adata.rs", 200, 10), ("/a/bdata.rs", 10, 20), ("/a/cdata.txt", 200, None)], "path string, size bigint, mtime bigint")
    run = lambda e, m={}: sorted(r[0] for r in df.filter(findexpr.column(findexpr.parse(e), m)).select("path").collect())  # noqa: E731, B006
    assert run("-name '*.rs' -size +100c") == ["/a/adata.rs"]
    assert run("( -name adata.rs -o -name bdata.rs ) -a ! -name bdata.rs") == ["/a/adata.rs"]
    assert run("-newer r", {"r": 15}) == ["/a/bdata.rs"] and run("-newer r") == []
    assert run("! -newer r", {"r": 15}) == ["/a/adata.rs", "/a/cdata.txt"]


def _glob(p, s):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p), s, re.S) is not None


def test_globs(spark):
    rng, names = random.Random(2), []
    names = ["".join(rng.choice("ab./*?[") for _ in range(rng.randint(0, 6))) for _ in range(200)] + ["x\ny", "é"]
    for glob in ("*", "?", "a*b", "*.*", "[", "a?", "**/a", "", "x?y", "?"):
        assert values(spark, glob_match(F.col("path"), glob), names) == [_glob(glob, n) for n in names], glob
    assert values(spark, glob_match(F.col("path"), "?", by_byte=True), ["é", "e"]) == [False, True]
    assert glob_regex("a.b") == r"(?s)\Aa\.b\z"


def test_regex_translation(spark):
    rows = ["foo", "foo\n", "FOO", "É", "a\rb", "price$"]
    assert values(spark, F.col("path").rlike(java_regex("foo$", True)), rows) == [True, False, False, False, False, False]
    assert values(spark, F.col("path").rlike(java_regex("foo", False)), rows)[:3] == [True, True, True]
    assert values(spark, F.col("path").rlike(java_regex(r"^\w$", True)), rows)[3]
    assert values(spark, F.col("path").rlike(java_regex("a.b", True)), rows)[4]
    assert values(spark, F.col("path").rlike(java_regex(r"[$]", True)), rows)[5]
    assert values(spark, F.col("path").rlike(java_regex("(?P<x>fo+)", True)), rows)[0]
    for bad in ("(?=a)", "(?<!a)b", r"(a)\1", "(", "[a", "a\\", "(?>a)"):
        with pytest.raises(ValueError):
            java_regex(bad, True)


def test_paths(spark):
    rows = ["/a/b.rs", "./docs/readme.md", "x.tar.gz", ".bashrc", "foo.", "/a.d/b", "/"]
    assert values(spark, text.extension(F.col("path")), rows) == ["rs", "md", "gz", "", "", "", ""]
    assert values(spark, text.depth(F.col("path")), rows) == [2, 1, 0, 0, 0, 2, 1]
    assert values(spark, text.basename(F.col("path")), rows)[:2] == ["b.rs", "readme.md"]
    assert values(spark, in_scope(F.col("path"), "src"), ["src/lib.rs", "srcx/lib.rs", "./src/a.rs", "src", "a/src/b"]) == [True, False, True, True, False]
    assert values(spark, in_scope(F.col("path"), "./src/"), ["src//lib.rs"]) == [True]
    assert values(spark, in_scope(F.col("path"), ""), ["x"]) == [True]


def test_fold_and_trigrams(spark):
    assert values(spark, text.ascii_fold(F.col("path")), ["ÀÉab", "ABZ"]) == ["ÀÉab", "abz"]
    keys = F.array_sort(F.transform(text.trigrams(F.col("path")), text.trigram_key))
    for s, got in zip(["abcabc", "ab", "日本", ""], values(spark, keys, ["abcabc", "ab", "日本", ""])):
        assert got == text.needle_trigrams(s)


def test_display(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([-5, 0, 1023, 1024, 1536, 1048576, 5 * 1024**3, 3 * 1024**5])], "i int, n bigint").orderBy("i")
    assert [r[0] for r in df.select(display.humansize(F.col("n"))).collect()] == ["0B", "0B", "1023B", "1.0K", "1.5K", "1.0M", "5.0G", "3072.0T"]
    assert values(spark, display.highlight(F.col("path"), "note"), ["/a/Note.rs", "none", "İnote"]) == ["/a/\x1b[1;31mNote\x1b[0m.rs", "none", "İnote"]
    assert values(spark, display.exec_command("wc {}", F.col("path")), ["a"]) == ["wc a"]


def test_ignore_rules(spark):
    def out(patterns, paths, root="/r"):
        rules = [r for p in patterns if (r := ignore_rule(p, root))]
        return values(spark, ignored(F.col("path"), F.lit(False), rules), paths)

    paths = ["keep.rs", "noise.log", "secret/hidden.rs", "a/secret", "a/b/noise.log", "build/x", "a/build"]
    assert out(["*.log", "secret"], paths) == [False, True, True, True, True, False, False]
    assert out(["/secret", "[", "", "# c"], paths) == [False] * 7  # an absolute path outside the root
    assert out(["/r/secret"], paths) == [False, False, True, False, False, False, False]
    assert out(["*.log", "!a/b/noise.log"], paths) == [False, True] + [False] * 5
    assert out(["build/"], paths) == [False] * 5 + [True, False]
    assert out(["a/**"], paths) == [False, False, False, True, True, False, True]
    assert out(["!/r/a/secret", "/r/a/secret", "!/r/a/secret"], ["a/secret"]) == [False]
    assert out(["a", "!a/b"], ["a/b/c"]) == [True]  # a pruned directory stays pruned


def test_types():
    assert type_extensions("nothing") == [] and "rs" in type_extensions("code") and len(TYPES) == 6
