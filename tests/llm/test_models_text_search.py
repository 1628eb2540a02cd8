"""Language ID, quality, HTML extraction, chat formatting and neighbour search: held-out accuracy and brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import chat_format, html_text, language_id, nearest, quality, registry

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, x int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 1.0, 2) for i, t, lang in rows], DOCS)


ALPHABETS = {"aa": "abcde", "bb": "fghij", "cc": "éèüñß"}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(1, 7))) for _ in range(n))


# -- language identification


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = language_id.BiGru(["a", "b", "c"])
    codes, mask = language_id._matrix([bytes(rng.integers(97, 100, n).tolist()) for n in (7, 96, 30)])
    target = np.array([0, 2, 1])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, grads = net.gradients(codes, mask, target)
    for name in ("xzf", "urb", "unf", "xnb", "of", "bias", "uzb", "xrf"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old, out = net.p[name][at], []
        for step in (1e-3, -1e-3):
            net.p[name][at] = old + step
            out.append(net.gradients(codes, mask, target)[0])
        net.p[name][at] = old
        assert (out[0] - out[1]) / 2e-3 == pytest.approx(grads[name][at], rel=2e-2, abs=1e-7), name


def test_inference_agrees_with_training_pass():
    net = language_id.BiGru(["a", "b"], seed=4)
    texts = [b"hello world" * 30, b"x", b"", "é".encode() * 100]
    data, at = b"".join(texts), np.cumsum([0, *map(len, texts)])
    got = net.documents(data, at)
    for text, means in zip(texts, got):
        total = np.zeros(2)
        for k in range(0, len(text), language_id.WINDOW):
            codes, mask = language_id._matrix([text[k : k + language_id.WINDOW]])
            states = {way: {x[0]: x[6] for x in net._run(way, codes, mask)} for way in "fb"}
            for t in range(int(mask.sum())):
                logits = states["f"][t] @ net.p["of"] + states["b"][t] @ net.p["ob"] + net.p["bias"]
                e = np.exp(logits - logits.max())
                total += (e / e.sum())[0]
        assert means == pytest.approx(total / max(len(text), 1), abs=1e-4)


def test_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 120)
    rng = random.Random(0)
    rows = [(k, spoken(rng, lang, rng.randint(1, 200)), lang) for k in range(240) for lang in [list(ALPHABETS)[k % 3]]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !?", "bb"), (1003, "a" * 200_000, None), (1004, "日本", None), (None, "abc abc", None)]
    got = {r["doc_id"]: r for r in language_id.identify_languages(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    held = [(i, lang) for i, _, lang in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows[:240])
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    unknown = language_id.identify_languages(docs(spark, [(1, "abc", None)])).collect()
    assert unknown[0]["lang_pred"] == "und" and language_id.identify_languages(docs(spark, [])).count() == 0


def test_every_language_is_sampled(spark):
    rows = [(k, f"text {k}", f"l{k % 150}" if k < 1500 else "l0") for k in range(8000)]
    sample = language_id.training_sample(docs(spark, rows))
    assert {r["lang"] for r in sample} == {f"l{k}" for k in range(150)} and len(sample) <= 150 * language_id.LEAST_DOCS


def brute_language(net, data):
    """Mean language probabilities of a text, byte by byte in plain arithmetic."""
    squash = lambda v: min(1.0, max(0.0, 0.25 * v + 0.5))
    p, size, total = net.p, language_id.HIDDEN, np.zeros(len(net.languages))
    for k in range(0, len(data), language_id.WINDOW):
        window, states = data[k : k + language_id.WINDOW], {}
        for way, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            h = [0.0] * size
            for t in order:
                inner = {g: [float(p[f"u{g}{way}"][:, j].astype(float) @ np.array(h)) for j in range(size)] for g in "zrn"}
                given = {g: p[f"x{g}{way}"][window[t]] for g in "zrn"}
                z, r = ([squash(given[g][j] + inner[g][j]) for j in range(size)] for g in "zr")
                n = [np.tanh(given["n"][j] + r[j] * inner["n"][j]) for j in range(size)]
                h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(size)]
                states[way, t] = np.array(h)
        for t in range(len(window)):
            e = np.exp(states["f", t] @ p["of"].astype(float) + states["b", t] @ p["ob"].astype(float) + p["bias"])
            total += e / e.sum()
    return total / max(len(data), 1)


def test_language_query_against_brute_force(spark, tmp_path):
    """The whole query on a small table: what is learned, and every document's verdict."""
    rng = random.Random(5)
    rows = [(k, spoken(rng, lang, rng.randint(1, 40)), lang) for k in range(60) for lang in [list(ALPHABETS)[k % 3]]]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 !?", "aa"), (103, "x", None), (104, "日本" * 40, "jj"), (105, "abcde " * 300, "aa")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    net = language_id.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert net.languages == sorted({lang for i, t, lang in rows if lang and t and zlib.crc32(str(i).encode()) % 3 != 1})
    got = {r["doc_id"]: r for r in registry.op8_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r, means = got[i], brute_language(net, (t or "").encode())
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not any(map(str.isalpha, t or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["score"] == pytest.approx(means.max(), abs=1e-3) and r["score"] == pytest.approx(means[net.languages.index(r["lang_pred"])], abs=1e-3)


def test_windows_come_from_all_over_a_text(spark):
    long = "".join(chr(0x4E00 + k) for k in range(6000))
    texts = language_id.training_sample(docs(spark, [(k, long if k % 2 else "short text", "aa") for k in range(12)]))
    for r in texts:
        if len(r["texts"]) == 1:
            assert r["texts"] == ["short text"]
        else:
            assert len(r["texts"]) == language_id.PLACES and all(len(x) == language_id.WINDOW for x in r["texts"])
            assert [long.index(x) // 1000 for x in r["texts"]] == list(range(language_id.PLACES))


def test_languages_of_the_given_table(spark, sf_dir):
    got = registry.op8_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id")
    share = got.filter("held_out AND n_chars > 100").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()["a"]
    assert share > 0.9


# -- quality


def test_flattened_trees_agree_with_walks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = quality.boost(x, y, 60)
    scores = model.scores(x)
    assert ((scores >= 0.5) == y).mean() > 0.9
    for row, score in list(zip(x, scores))[:50]:
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1)
            total += model.value[t, node]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for k in range(400):
        good = k % 3 > 0
        text = " ".join(rng.choice(["river", "stone", "Cloud", "walks."]) if good else rng.choice(["BUY!!", "$$$", "click|here"]) for _ in range(rng.randint(20, 60)))
        rows.append((k, text, None))
        marks.append((k, int(good), 0))
    rows += [(900, None, None), (901, "", None), (902, "z " * 100_000, None)]
    labels = spark.createDataFrame([*marks, (5, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs(spark, rows), labels).collect()}
    assert len(got) == len(rows) and got[900]["score"] == got[901]["score"]
    held = [(i, q) for i, q, _ in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == q for i, q in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    none = quality.quality_scores(docs(spark, rows[:3]), labels.limit(0)).collect()
    assert [r["score"] for r in none] == [0.5] * 3 and quality.quality_scores(docs(spark, []), labels).count() == 0


def brute_statistics(text):
    """The statistics of a text, counted one by one."""
    data = (text or "").encode()
    n = max(len(data), 1)
    words = [w for w in data.replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    lines, w = data.split(b"\n"), max(len(words), 1)
    letters, capitals = sum(chr(b).isascii() and chr(b).isalpha() for b in data), sum(65 <= b <= 90 for b in data)
    out = [math.log(1 + len(data)), math.log(1 + len(words)), letters / n, sum(b > 127 for b in data) / n, capitals / max(letters, 1), sum(48 <= b <= 57 for b in data) / n, sum(b in b" \t\n\r\x0b\x0c" for b in data) / n]
    out += [sum(len(x) for x in words) / w, max([len(x) for x in words], default=0), len({*words}) / w, sum(words[k] == words[k + 1] for k in range(len(words) - 1)) / w, sum(x.isupper() for x in words) / w, sum(x[-1:] in (b".", b"!", b"?") for x in words) / w]
    out += [sum(len(x) < 4 for x in words) / w, sum(x[:1].isupper() for x in words) / w, len(lines) / n, len({*lines}) / len(lines), max(len(x) for x in lines) / n, len(zlib.compress(data, 1)) / n]
    return out + [sum(b == s[0] for b in data) / w for s in quality.SYMBOLS]


def brute_boost(x, y):
    """Scores of boosted trees that are grown node by node from lists of rows; returns a function of statistics."""
    n, width = len(x), len(x[0])
    columns = np.array(x).T
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, quality.BINS)[1:-1])) for c in columns]
    base = math.log(np.clip(np.mean(y), 1e-4, 1 - 1e-4) / (1 - np.clip(np.mean(y), 1e-4, 1 - 1e-4)))
    score, trees = np.full(n, base), []

    def grow(rows, g, h, depth):
        if depth == quality.DEPTH:
            return quality.RATE * g[rows].sum() / (h[rows].sum() + quality.RIDGE)
        best = (1e-9, None)
        for f in range(width):
            for e in edges[f]:
                left = rows[columns[f][rows] <= e]
                hl, hr = h[left].sum(), h[rows].sum() - h[left].sum()
                if min(hl, hr) < quality.LEAST / 8:
                    continue
                gl, gr = g[left].sum(), g[rows].sum() - g[left].sum()
                gain = gl**2 / (hl + quality.RIDGE) + gr**2 / (hr + quality.RIDGE) - (gl + gr) ** 2 / (hl + hr + quality.RIDGE)
                gain = round(gain, 9)
                if gain > best[0]:
                    best = (gain, (f, e))
        if best[1] is None:
            return grow(rows, g, h, quality.DEPTH)
        f, e = best[1]
        return (f, e, grow(rows[columns[f][rows] <= e], g, h, depth + 1), grow(rows[columns[f][rows] > e], g, h, depth + 1))

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(quality.TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(n), y - p, p * (1 - p), 0))
        score = score + [walk(trees[-1], row) for row in x]
    return lambda row: 1 / (1 + math.exp(-(base + sum(walk(t, row) for t in trees))))


def test_quality_query_against_brute_force(spark, tmp_path):
    """The whole query on a small table: statistics, trees and scores."""
    rng, rows, marks = random.Random(6), [], []
    for k in range(90):
        good = rng.random() < 0.6
        words = [rng.choice(["river", "Stone,", "cloud", "walks.", "é"] if good or rng.random() < 0.3 else ["BUY!!", "$$$", "12", "click|here"]) for _ in range(rng.randint(5, 60))]
        rows.append((k, rng.choice([" ", "\n", " "]).join(words), None))
        marks.append((k, int(good), 0))
    rows += [(900, None, None), (901, "", None), (902, "z\n" * 500, None), (None, "river walks.", None), (5, rows[5][1], None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*marks, (6, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    label = {i: q for i, q, _ in marks}
    taught = [(t, label[i]) for i, t, _ in rows if i in label and zlib.crc32(str(i).encode()) % 3 != 1]
    score = brute_boost([brute_statistics(t) for t, _ in taught], np.array([q for _, q in taught], float))
    got = registry.op6_quality(spark, str(tmp_path)).collect()
    want = {i: score(brute_statistics(t)) for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 3 == 1)


def test_quality_of_the_given_table(spark, sf_dir):
    got = registry.op6_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out")
    share = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a")).first()["a"]
    assert share > 0.85


# -- HTML


def brute_viterbi(field, rows):
    best = None
    for code in range(2 ** len(rows)):
        labels = [code >> k & 1 for k in range(len(rows))]
        score = sum(u[y] for u, y in zip(field.unary(rows), labels)) + sum(field.pairs[a][b] for a, b in zip(labels, labels[1:]))
        if best is None or score > best[0] + 1e-12:
            best = (score, labels)
    return best


def test_viterbi_is_optimal():
    rng = random.Random(2)
    for _ in range(60):
        field = html_text.Field({f"f{k}": (rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(5)}, [[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)])
        rows = [[f"f{rng.randrange(6)}" for _ in range(3)] for _ in range(rng.randint(1, 7))]
        labels = field.viterbi(rows)
        score = sum(u[y] for u, y in zip(field.unary(rows), labels)) + sum(field.pairs[a][b] for a, b in zip(labels, labels[1:]))
        assert score == pytest.approx(brute_viterbi(field, rows)[0])


def test_blocks():
    texts = lambda h: [b[0] for b in html_text.blocks(h)]
    assert texts("<p>a<b>b</b> c<br>d<p>e&amp;f &lt;x&gt;&#233;") == ["ab c d", "e&f <x>é"]
    assert texts("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><title>t</title>x") == ["x"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("a \n\t b&nbsp; c") == ["a b c"] and texts("") == [] and texts("<div") == [] and texts("1 < 2 and 3 > 2") == ["1 < 2 and 3 > 2"]
    stack = [t for t, _ in html_text.blocks("<div><p>a<div>b")[1][1]]
    assert stack == ["div", "div"]


def test_blocks_after_hidden_elements_without_an_end():
    texts = lambda h: [b[0] for b in html_text.blocks(h)]
    assert texts("<datalist><option value=a>A<option value=b>B</datalist><article><p>Text.</p></article>") == ["Text."]
    assert texts("<select><option>a<option>b</select>x<form><select><option>c</form><p>y") == ["x", "y"]
    for name in ("canvas", "audio", "video", "template", "svg"):
        assert texts(f"<article><{name}>no<p>First.</p><p>Second.</p></article><p>Third.") == ["First.", "Second.", "Third."]
        assert texts(f"<div><{name}>no</div><p>After.</p>") == ["After."] and texts(f"<p>a<span><{name}>no</span>b") == ["ab"]
        assert texts(f"<p>a<{name}>no<b>no</b></{name}>b") == ["ab"]
    assert texts("a<video><p>no</p></video>b<template><p>no</p><template>no</template>no</template>c") == ["abc"]
    assert texts("<p>Press the <button>red</button> key.</p>") == ["Press the red key."] and texts("<script>no<p>no") == []
    assert texts("<p>a<object>b</object><math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><noscript>c</noscript>") == ["abx=1", "c"]
    assert len(texts("<div>" + "<template><p>a" * 20_000)) == 20_000


def test_stray_quotes_in_tags():
    texts = lambda h: [b[0] for b in html_text.blocks(h)]
    assert texts("<article><p title=it's>First text.</p><p>It isn't lost</p></article>") == ["First text.", "It isn't lost"]
    assert texts("<p title=\"5\" tall\">a</p><p>\"b\"</p>") == ["a", '"b"'] and texts("<p title=\"x>a</p><p>b") == ["a", "b"]
    assert texts("<p title = 'a > b' id=\">\">c<a href=/?q=\"d>e</a>") == ["ce"] and texts("<p ' \">a 'b\"") == ["a 'b\""]


@pytest.mark.parametrize("piece", ["<a ", "<div>x", "<x>y", "<div class='q{k}'>x", "<li><div><x></li>", "<select><canvas>x", "<button><x></y>", "<a x=\"'>", "<template><p>a", "<!--", "<svg><g>", "<td><tr>x", "</p></q>", "<p title='", "= '\""])
def test_time_is_linear_on_hostile_pages(piece):
    import time

    field = html_text.default_field()
    page = "".join(piece.replace("{k}", str(k)) for k in range(1_000_000 // len(piece))) + "'"
    start = time.process_time()
    html_text.extract(page, field)
    assert time.process_time() - start < 12  # a second or two alone; quadratic ways take minutes


def test_elements_share_their_ancestors():
    found = html_text.blocks("<div>a" * 3000)
    assert found[-1][1].parent is found[-2][1] and len(list(found[-1][1])) == 3000
    field = html_text.default_field()
    rows = html_text.features(found, field.weights)
    assert rows[5] == [*rows[4]] or len(rows[5]) == len(rows[4])


def test_held_out_layout_families():
    """Frames, holders and page words of one half of the families teach the field; it is tried on the other half."""
    right = total = 0
    for k in (0, 1):
        taught = html_text.train_field(html_text.training_pages(700, 5, html_text.FRAMES[k::2], html_text.HOLDERS[k::2]))
        for page, labels in html_text.training_pages(200, 77, html_text.FRAMES[1 - k :: 2], html_text.HOLDERS[1 - k :: 2]):
            rows = html_text.features(html_text.blocks(page))
            right += sum(a == b for a, b in zip(taught.viterbi(rows), labels))
            total += len(labels)
    assert right / total > 0.85


def test_pages_without_an_article_element():
    field = html_text.default_field()
    body = "<h1>Rivers in spring</h1><p>The water rose for nine days and then it fell again, as it does every year.</p><p>People came to see it from the bridge.</p>"
    want = "Rivers in spring The water rose for nine days and then it fell again, as it does every year. People came to see it from the bridge."
    for page in (
        f"<html><body><div class='nav'><a href=/>Home</a> <a href=/n>News</a></div><div id='content'>{body}</div><div class='footer'>Copyright 2020</div></body></html>",
        f"<html><body><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul><div>{body}</div><div id='r'><h3>Most read</h3></div></body></html>",
        f"<html><body><main>{body}</main><div class='c'>Comments Bob: nice post</div></body></html>",
        f"<html><body><div class='story'>{body}</div><form><p>Subscribe to our newsletter</p><button>Go</button></form></body></html>",
    ):
        assert html_text.extract(page, field) == want, page


def test_boilerplate_words_within_an_article_stay():
    field = html_text.default_field()
    parts = ["Plain start of it.", "Sign up to see more. password=b8a6bab61dc0d4e3d1", "Copyright 2020 Someone. All rights reserved.", "Search", "Subscribe to our newsletter", "a | b | c | d", "Comments", "Last words here."]
    page = "<nav><a href=/>Home</a></nav><article><h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in parts) + "</article><footer>Copyright</footer>"
    assert html_text.extract(page, field) == " ".join(["Title", *parts])


def test_extraction_of_unseen_layouts():
    field = html_text.default_field()
    held, right, total = html_text.training_pages(150, seed=99), 0, 0
    for page, labels in held:
        rows = html_text.features(html_text.blocks(page))
        right += sum(a == b for a, b in zip(field.viterbi(rows), labels))
        total += len(labels)
    assert right / total > 0.93
    page = "<html><head><title>T</title></head><body><header><a href='/'>Site</a></header><nav><ul><li><a href=x>One</a></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>The Title</h1><p><b>First words here.<br><p>Second &amp; last.</p></article><aside>Buy this now, it is cheap.</aside><section class='comments'><p>I liked it a lot.</p></section><form><p>Subscribe to our letter.</p></form><footer>&copy; Site</footer>"
    assert html_text.extract(page, field) == "The Title First words here. Second & last."


def test_pages_given(spark, sf_dir):
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = registry.op1_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        inner = re.sub(r"</?b>", "", inner)
        want = " ".join(html_text.html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_page_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" + "word " * 50_000), (None, "u", "<article><p>Here it is, a text.</article>"), (3, "u", "<<<>>>&&&;")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = html_text.extract_pages(df).collect()
    assert len(got) == 5 and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert html_text.extract_pages(df.limit(0)).count() == 0


# -- chat


def test_template_language():
    render = lambda s, **v: chat_format.Template(s).render(v)
    assert render("a{{ 1 + 2 }}b{{ 'x' ~ 1 }}")[0] == "a3bx1" and render("{{ x.y['z'] }}", x={"y": {"z": 5}})[0] == "5"
    assert render("{% for m in l %}{{ loop.index }}{{ m }}{% if not loop.first %}!{% endif %}{% endfor %}", l=["a", "b"])[0] == "1a2b!"
    assert render("{% if x == 1 %}one{% elif x == 2 %}two{% else %}more{% endif %}", x=2)[0] == "two"
    assert render("{{ 'a' if x else 'b' }}{{ ' q ' | trim | upper }}  {%- set y = 3 -%}  {{ y }}", x=False)[0] == "bQ3"
    assert render("x{% generation %}abc{% endgeneration %}y{# no #}") == ("xabcy", [(1, 4)])
    assert render("{{ x and y or 'z' }}{{ 2 > 1 and 'in' in 'bin' }}", x=0)[0] == "ztrue"
    for bad in ("{% for %}{% endfor %}", "{% if x %}", "{{ }}", "{{ a( }}", "{{ x.__class__() }}", "{{ 1 | nothing }}", "{% run x %}", "{{ (1 }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.Template(bad)
    assert render("{{ x.__class__ }}{{ x.__dict__ }}", x={"a": 1})[0] == ""  # Python's attributes are out of reach
    assert chat_format.fold(chat_format.parse("a{{ 'b' ~ 2 }}{% if true %}c{% endif %}{{ x if false else 'd' }}")) == ("block", [("const", "ab2cd")])


def test_template_errors_and_lists():
    render = lambda s, **v: chat_format.Template(s).render(v)[0]
    assert render("{{ l | length }}{{ 'abc' | length }}{{ d | length }}{{ 12 | length }}", l=["a", "b", "c"], d={"x": 1}) == "3312"
    assert render("{{ '}}' }}{% if x == '%}' %}y{% endif %}{{ \"it's -}}\" }}", x="%}") == "}}yit's -}}"
    assert render("{% for m in l %}{% for x in m %}{{ loop.index }}{% if loop.last %}.{% endif %}{% endfor %}{{ loop.index0 }};{% endfor %}", l=["ab", "c"]) == "12.0;1.1;"
    for bad in ("{{ 1 < 'a' }}", "{{ 1 in 2 }}", "{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}", "{{ " + "not " * 5000 + "x }}", "{{ " + " ~ ".join(["x"] * 20_000) + " }}", "{% if x %}" * 3000 + "{% endif %}" * 3000, "{{ 'a }}", "a {{ b", "a {% if x", "{# b"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.Template(bad)
    with pytest.raises(chat_format.TemplateError):
        render("{{ x < 1 }}", x="a")


@pytest.mark.parametrize("source, streams", [
    ("{{ 'BOS ' }}{% for m in messages %}[{{ loop.index }}{{ m.text }}{% for c in 'ab' %}{{ loop.index }}{% endfor %}{% if loop.last %}!{% endif %}]{% endfor %} END", True),
    ("{{ messages | length }}{% for m in messages %}{{ m.role }}{{ messages[0].text }},{% endfor %}", False),
    ("{% for k in 'xy' %}{% for m in messages %}{{ k }}{{ m.text }}{% endfor %}{% endfor %}", False),
    ("no messages at all", False),
])
def test_segments_are_one_rendering(spark, monkeypatch, source, streams):
    monkeypatch.setattr(chat_format, "SEGMENT_TURNS", 4)
    template = chat_format.Template(source)
    assert template.streams == streams
    rows = [(conv, turn, "user", f"t{conv}.{turn}") for conv in (1, 2, 3) for turn in range((conv - 1) * 9 + 1)]
    got = {}
    for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), source).orderBy("conv_id", "segment").collect():
        got.setdefault(r["conv_id"], []).append(r["text"])
    for conv in (1, 2, 3):
        said = [{"role": "user", "text": t} for c, _, _, t in rows if c == conv]
        assert "".join(got[conv]) == template.render({"messages": said})[0]
    assert (len(got[3]) > 1) == ("for m in messages" in source)


def test_escape_is_reversible():
    rng, parts = random.Random(3), [*chat_format.CONTROL, "\\", "<", "|", "im_end", ">", "[", "\n", "é", "a"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        for use in (chat_format.escape, chat_format.escape_line):
            out = use(text)
            assert chat_format.unescape(out) == text and not any(c in out for c in chat_format.CONTROL)


CHAT = "conv_id bigint, turn bigint, role string, text string, segment int, mask string"


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SEGMENT_TURNS", 7)
    rng, rows = random.Random(4), []
    for conv in [*range(12), None]:
        for turn in range(rng.choice([1, 2, 3, 40])):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "us\ner", None]), rng.choice([None, "", "hi\n", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "é" * 50, "\\", "a" * 20_000])))
    rows += [(99, 0, "user", "b"), (99, 0, "user", "a"), (99, None, "assistant", "first"), (99, 0, "user", "a")]
    df = spark.createDataFrame([(*r, 1, "m") for r in rows], CHAT)
    formatted = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(formatted).collect()}
    lengths = {}
    for r in formatted.collect():
        lengths[r["conv_id"]] = lengths.get(r["conv_id"], 0) + len(r["text"])
    assert set(got) == {r[0] for r in rows}
    none_first = lambda v: (v is not None, v if v is not None else 0)
    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (none_first(x[1]), (x[2] is not None, (x[2] or "").encode()), (x[3] is not None, (x[3] or "").encode())))
        said = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        whole = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in turns)
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["formatted_chars"] == lengths[conv]
    assert chat_format.conversation_digests(chat_format.format_conversations(df.limit(0))).count() == 0


# -- neighbours


def brute_nearest(ids, x, k=20, every=20):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            scores = x @ q
            out[i] = [ids[j] for j in sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-round(scores[j], 12), ids[j]))[:k]]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len(found.get(q, set()) & set(w)) / len(w) for q, w in want.items()])


VECTORS = "vec_id bigint, embedding array<float>, label int, list int, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, 2) for i, v in rows], VECTORS)


def test_graph_finds_the_nearest_centroid():
    rng = np.random.default_rng(3)
    c, points = rng.normal(size=(300, 16)), rng.normal(size=(200, 16))
    ids, _ = nearest.CentroidGraph(c).search(points, 64)
    exact = ((points[:, None] - c) ** 2).sum(2).argmin(1)
    assert (ids[:, 0] == exact).mean() > 0.97


def test_neighbours_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8) * rng.uniform(0.1, 3)) for k in range(300)]
    rows += [(400 + k, np.ones(8)) for k in range(100)]  # copies: ties go to the smaller id
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [None] + [1.0] * 7), (1060, [float("nan")] * 8), (1080, [float("inf")] * 8), (1100, [1.0] * 3), (None, [1.0] * 8)]
    got = nearest.nearest_neighbours(vectors(spark, rows + bad), prune=9.0).collect()
    ids, x = [i for i, _ in rows], np.stack([np.asarray(v, np.float32).astype(float) for _, v in rows])
    want = brute_nearest(ids, x)
    table = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        table.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[ids.index(r["query_id"])] @ x[ids.index(r["vec_id"])]), abs=1e-12)
    assert table == want
    assert nearest.nearest_neighbours(vectors(spark, bad[:5])).count() == 0
    few = nearest.nearest_neighbours(vectors(spark, [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 2), (0, 2, 1)]


def test_recall_on_the_given_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    assert recall(registry.op3_nearest(spark, sf_dir).collect(), brute_nearest(ids, x)) >= 0.9


@pytest.mark.parametrize("kind", ["norms", "clusters"])
def test_recall_on_uneven_vectors(spark, kind):
    """The production ratio on vectors of unequal norm and on clustered ones."""
    rng = np.random.default_rng(7)
    if kind == "norms":
        x = rng.normal(size=(3000, 32))
        x *= (rng.uniform(0.5, 1.5, len(x)) / np.linalg.norm(x, axis=1))[:, None]
    else:
        x = rng.normal(size=(400, 32))[rng.integers(0, 400, 4000)] + 0.3 * rng.normal(size=(4000, 32))
        x /= np.linalg.norm(x, axis=1)[:, None]
    x = x.astype(np.float32).astype(float)
    got = nearest.nearest_neighbours(vectors(spark, list(enumerate(x)))).collect()
    assert recall(got, brute_nearest(list(range(len(x))), x)) >= 0.92


def test_wide_beams_leave_no_list_out():
    """All lists are within a wide ratio, more than a beam holds at first."""
    rng = np.random.default_rng(8)
    graph = nearest.CentroidGraph(rng.normal(size=(3 * nearest.BEAM, 8)))
    rows, lists = nearest.lists_of(graph, rng.normal(size=(5, 8)), 99.0, 3 * nearest.BEAM)
    assert sorted(zip(rows, lists)) == [(q, c) for q in range(5) for c in range(3 * nearest.BEAM)]


def test_every_query_gets_k_rows(spark):
    """A small far-off cluster, whose lists alone hold fewer than k candidates."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 16)) * 0.05
    x[:, 0] += 1
    far = np.arange(0, 2000, 140)
    x[far, 0] -= 2
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = nearest.nearest_neighbours(vectors(spark, list(enumerate(x))), prune=0.0).collect()
    count = {}
    for r in got:
        count[r["query_id"]] = count.get(r["query_id"], 0) + 1
    assert count == {q: 20 for q in range(0, 2000, 20)}


def test_neighbours_of_repeated_ids_and_huge_values(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 4))
    rows = [(k // 4, v) for k, v in enumerate(x)] + [(60 + k, x[0]) for k in range(40)] + [(7, x[3])] * 30
    doubles = "vec_id bigint, embedding array<double>"
    got = nearest.nearest_neighbours(spark.createDataFrame([(i, [float(c) * 1e150 for c in v]) for i, v in rows], doubles), prune=9.0).collect()
    table = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        table.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(table) == {0, 20, 40, 60, 80}
    for q, found in table.items():
        best = []
        for own in (v for i, v in rows if i == q):  # the query is one of the id's vectors
            scores = {}
            for i, v in rows:
                if i != q:
                    s = float(((own * 1e150) * (v * 1e150)).sum())
                    scores[i] = max(s, scores.get(i, -np.inf))
            best.append(sorted(scores.items(), key=lambda t: (-t[1], t[0]))[:20])
        assert [i for i, _ in found] in [[i for i, _ in b] for b in best]


def test_short_cells_and_blocks_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(1500, 8))
    whole = nearest.nearest_neighbours(vectors(spark, list(enumerate(x))), prune=9.0).collect()
    monkeypatch.setattr(nearest, "CELLS", 40)
    monkeypatch.setattr(nearest, "BLOCK", 7)
    monkeypatch.setattr(nearest, "HELD", 50)
    split = nearest.nearest_neighbours(vectors(spark, list(enumerate(x))), prune=9.0).collect()
    assert sorted(split) == sorted(whole) and len(whole) == 75 * 20
    want = brute_nearest(list(range(len(x))), np.asarray(x, np.float32).astype(float))
    assert recall(whole, want) == 1.0


def test_one_id_for_all_rows(spark, monkeypatch):
    """A sample by the ids' hashes may hold no row then."""
    monkeypatch.setattr(nearest, "SAMPLE", 10)
    for one in (20, 40, 60):
        rows = [(one, [float(k), 1.0]) for k in range(1, 60)] + [(one + 1, [1.0, 2.0])]
        got = nearest.nearest_neighbours(vectors(spark, rows)).collect()
        assert [(r["query_id"], r["vec_id"]) for r in got] == [(one, one + 1)]


def test_lists_are_balanced():
    rng = np.random.default_rng(14)
    points = np.concatenate([rng.normal(size=(3000, 12)), 5 + 0.3 * rng.normal(size=(1000, 12))])
    centroids, weights = nearest.balanced_centroids(points, 100)
    sizes = np.bincount(nearest._nearest(points, centroids, weights, 1)[0][:, 0], minlength=100)
    assert sizes.max() <= 2.5 * sizes.mean()
