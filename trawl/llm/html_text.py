"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into blocks: runs of text between block-level tags, each with its open ancestors. The field labels every
block as article or other from ancestor-tag, class-word and text features, with a transition weight between
neighbours; it is trained on labelled pages (generated layouts, see ``training_pages``) by gradient ascent on the
likelihood with forward-backward sums, and decoded by Viterbi.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is raw text and no text of the page: without an end tag they go to the end of the page.
RAW = {"script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp"}
#: Elements whose content is no text of the page; NESTING: those that may stand in themselves.
HIDDEN = RAW | {"template", "svg", "select", "option", "canvas", "audio", "video", "annotation", "annotation-xml"}
NESTING = {"template", "svg"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements inside a line of text; all others start and end blocks.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "object", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msup", "msub", "msubsup", "msqrt", "mroot", "mover", "munder", "munderover", "mtable", "mtr", "mtd", "mstyle", "mspace", "mpadded", "mphantom", "menclose", "semantics"}
#: What an opening tag closes, up to the nearest container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "aside", "nav", "header", "footer", "form", "blockquote", "figure", "fieldset", "td", "th"}
#: Void or inline elements that still break a line of text.
BREAKS = {"br", "hr"}
#: Block-level tags that end an unclosed svg.
LEAVES_SVG = SCOPE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre"}

#: A comment, a declaration or a tag. A quote matters at the start of an attribute's value only; nothing backtracks.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORD = re.compile(r"[a-z]+")


class Node:
    """An open block element; its blocks share it, and it its parents. Iterating gives (tag, class words) from the top."""

    __slots__ = ("tag", "words", "parent", "found", "own")

    def __init__(self, tag: str, words: tuple, parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.found = self.own = None

    def __iter__(self) -> Iterator[tuple[str, tuple]]:
        chain, node = [], self
        while node is not None and node.parent is not None:
            chain.append((node.tag, node.words))
            node = node.parent
        return iter(chain[::-1])


#: text, innermost element, share of the text that lies in links, share that lies in buttons
Block = tuple[str, Node, float, float]


class _Open:
    """The open elements of a page: a stack with counts, so that no tag looks through all of it in vain."""

    def __init__(self):
        self.top = Node("", (), None)
        self.counts: dict[str, int] = {}
        self.inner: list[dict[str, int]] = [{}]  # counts since the last container, which is counted with what it holds

    def __contains__(self, tag: str) -> bool:
        return self.counts.get(tag, 0) > 0

    def push(self, tag: str, words: tuple) -> None:
        self.top = Node(tag, words, self.top)
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if tag in SCOPE:
            self.inner.append({})
        self.inner[-1][tag] = self.inner[-1].get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.top.tag
        self.top = self.top.parent
        self.counts[tag] -= 1
        self.inner[-1][tag] -= 1
        if tag in SCOPE:
            self.inner.pop()
        return tag

    def close(self, tag: str) -> None:
        """Close the innermost element of that name with all in it, if there is one."""
        while tag in self and self.pop() != tag:
            pass

    def close_before(self, tag: str) -> None:
        """Close what the opening tag ends, no further than the nearest container."""
        ends = CLOSES.get(tag, {"p"})
        if any(self.inner[-1].get(e) for e in ends):
            while self.pop() not in ends:
                pass


def _raw_end(page: str, at: int, name: str) -> int:
    end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
    return end.end() if end else len(page)


def _hidden_end(page: str, at: int, name: str, around: _Open, loose: set[str]) -> int:
    """Where the content of a hidden element ends that was opened before ``at``; around: the elements then open.

    That is its end tag. Where that is missing, it is the first block-level tag within, or the next element of its
    name, or the end tag of an element around it. An option ends at the first of all these. Names that missed their end
    tag once are ``loose``: further ones end at the first block-level tag, so a page is not read over and over.
    """
    if name in RAW:
        return _raw_end(page, at, name)
    inner: list[str] = []
    counts: dict[str, int] = {}
    block = None
    while found := TOKEN.search(page, at):
        at, tag = found.end(), (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if counts.get(tag, 0) > 0:
                while (last := inner.pop()) != tag:
                    counts[last] -= 1
                counts[tag] -= 1
            elif tag == name:
                return at
            elif tag in around or tag in INLINE:
                block = found.start() if block is None else block
                break
        elif tag == name and name not in NESTING:
            block = found.start() if block is None else block
            break
        elif tag in RAW:
            at = at if found[0].endswith("/>") else _raw_end(page, at, tag)
        elif tag not in VOID:
            if tag not in INLINE and tag not in HIDDEN and "-" not in tag and block is None and (name != "svg" or tag in LEAVES_SVG) and tag not in ("optgroup", "foreignobject"):
                block = found.start()
                if name == "option" or name in loose:
                    break
            if not found[0].endswith("/>"):
                inner.append(tag)
                counts[tag] = counts.get(tag, 0) + 1
    loose.add(name)
    return len(page) if block is None else block


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; blocks without text are left out. Time is linear in the page's length."""
    out: list[Block] = []
    stack = _Open()
    pieces: list[str] = []
    loose: set[str] = set()
    linked = pressed = 0
    in_link = in_button = False
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked, pressed
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((text, stack.top, min(1.0, linked / len(text)), min(1.0, pressed / len(text))))
            pieces.clear()
        linked = pressed = 0

    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            pieces.append(page[at:])
            break
        if found.start() > at:
            pieces.append(page[at : found.start()])
            if in_link:
                linked += found.start() - at
            if in_button:
                pressed += found.start() - at
        at = found.end()
        name = found[2]
        if not name:
            continue
        name, closing = name.lower(), bool(found[1])
        if name in HIDDEN:
            if not closing and not found[0].endswith("/>"):
                at = _hidden_end(page, at, name, stack, loose)
            continue
        if name in BREAKS:
            pieces.append(" ")
            if name == "hr":
                flush()
            continue
        if name == "a":
            in_link = not closing
        if name == "button":
            in_button = not closing
        if name in INLINE:
            continue
        flush()
        in_link = in_button = False
        if name in VOID:
            continue
        if closing:
            stack.close(name)
            continue
        stack.close_before(name)
        if not found[0].endswith("/>"):
            words = " ".join(next(x for x in m if x) if any(m) else "" for m in NAMES.findall(found[3] or ""))
            stack.push(name, tuple(WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", words).lower())))
    flush()
    return out


def _bucket(x: float, edges: tuple) -> int:
    return sum(x > e for e in edges)


def _inherited(node: Node, known: Container[str] | None) -> frozenset:
    """Features of the element and those around it, each once; an element without new ones shares its parent's set."""
    chain = []
    while node.found is None:
        chain.append(node)
        if node.parent is None:
            break
        node = node.parent
    for node in reversed(chain):
        if node.parent is None:
            node.found, node.own = frozenset(["outside"]), ()
            continue
        tag, found = node.tag, node.parent.found
        new = {f"class:{w}" for w in node.words}
        if tag not in ("html", "body"):
            new.add(f"in:{tag}")
        if tag in ("article", "main"):
            found = frozenset(f for f in found if f != "outside" and not f.startswith("inner:"))
        elif "outside" not in found and tag not in ("p", "div", "section"):
            new.add(f"inner:{tag}")
        own = {f"own:{tag}", *(f"own-class:{w}" for w in node.words)}
        if known is not None:
            new, own = {f for f in new if f in known}, {f for f in own if f in known}
        node.found, node.own = found if new <= found else found | new, tuple(sorted(own))
    return chain[0].found if chain else node.found


def _cues(text: str) -> set[str]:
    """The words that pages use around articles, among the first and last few words of a text."""
    words = WORD.findall(text[:160].lower())[:8] + WORD.findall(text[-80:].lower())[-4:]
    return {f"cue:{w}" for w in words if w in CUES}


def features(page_blocks: list[Block], known: Container[str] | None = None) -> list[list[str]]:
    """The features of each block; known: those that matter, if only some do."""
    out, last = [], len(page_blocks) - 1
    for k, (text, node, linked, pressed) in enumerate(page_blocks):
        words = text.count(" ") + 1
        inherited = _inherited(node, known)
        cues = _cues(text) if "outside" in inherited else set()  # within an article element, words alone prove nothing
        out.append([
            *inherited, *node.own, "any", f"words:{_bucket(words, (2, 5, 10, 20, 40, 80))}", f"links:{_bucket(linked, (0.0, 0.3, 0.7))}", f"buttons:{_bucket(pressed, (0.0, 0.7))}", *cues, f"cues:{min(len(cues), 3)}:{_bucket(words, (6, 15))}",
            f"end:{'stop' if text[-1] in '.!?…:”\"' else 'open'}", f"copy:{'©' in text[:200] or '(c)' in text[:200].lower()}", f"first:{k == 0}", f"last:{k == last}",
        ])
    return out


# -- the labelled pages

#: Places of boilerplate: opening and closing tag, and what stands in it. {n} is a number.
FRAMES = [
    ("<nav>", "</nav>", "menu"), ("<nav class='menu top'>", "</nav>", "menu"), ("<ul class='nav navbar'>", "</ul>", "menu"), ("<div class='menu' id='main-menu'>", "</div>", "menu"), ("<div class='breadcrumb'>", "</div>", "menu"), ("<div role='navigation'>", "</div>", "menu"),
    ("<header>", "</header>", "title"), ("<div class='header site-header' id='header'>", "</div>", "title"), ("<div id='masthead' class='banner'>", "</div>", "title"),
    ("<footer>", "</footer>", "legal"), ("<div class='footer' id='footer'>", "</div>", "legal"), ("<div class='copyright'>", "</div>", "legal"), ("<footer class='site-footer'>", "</footer>", "legal"),
    ("<aside>", "</aside>", "teaser"), ("<aside class='sidebar'>", "</aside>", "teaser"), ("<div class='sidebar widget'>", "</div>", "teaser"), ("<div class='related links'>", "</div>", "menu"), ("<div class='share social'>", "</div>", "menu"), ("<div class='newsletter subscribe signup'>", "</div>", "teaser"),
    ("<div class='ad'>", "</div>", "teaser"), ("<div class='ads advert'>", "</div>", "teaser"), ("<div class='advertisement'>", "</div>", "teaser"), ("<div class='promo sponsored'>", "</div>", "teaser"), ("<div id='banner-ad'>", "</div>", "teaser"), ("<ins class='adsbygoogle'>", "</ins>", "none"),
    ("<div class='cookie notice'>", "</div>", "teaser"), ("<div class='cookie-banner consent gdpr'>", "</div>", "teaser"), ("<div class='notice alert'>", "</div>", "teaser"), ("<div class='popup modal overlay'>", "</div>", "teaser"), ("<div role='alert'>", "</div>", "teaser"),
    ("<div class='hdr top topbar'>", "</div>", "title"), ("<div class='side rail column'>", "</div>", "teaser"), ("<div class='foot bottom'>", "</div>", "legal"), ("<div class='toolbar tags meta'>", "</div>", "menu"), ("<table class='nav layout'><tr><td>", "</td></tr></table>", "menu"), ("<table><tr><td class='nav menu'>", "</td></tr></table>", "menu"),
    ("<form action='/go'>", "</form>", "form"), ("<form class='search'>", "</form>", "form"), ("<div class='login'><form>", "</form></div>", "form"),
    ("<div class='comments' id='comments'>", "</div>", "comment"), ("<section class='comments'>", "</section>", "comment"), ("<div class='comment'>", "</div>", "comment"), ("<ol class='comment-list'>", "</ol>", "comment"), ("<div id='disqus thread' class='replies'>", "</div>", "comment"), ("<section id='respond' class='discussion'>", "</section>", "comment"),
]
#: Places of boilerplate whose names say nothing: only what stands in them does.
BARE = [("<div>", "</div>"), ("<div id='r'>", "</div>"), ("<div class='c'>", "</div>"), ("<div id='x'><div>", "</div></div>"), ("<section>", "</section>"), ("<p>", "</p>"), ("<ul><li>", "</li></ul>"), ("", "<hr>")]
#: Places of the article.
HOLDERS = [
    ("<article>", "</article>"), ("<article class='post'>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<div class='content'>", "</div>"), ("<div id='content' class='main'>", "</div>"), ("<div class='article body'>", "</div>"),
    ("<div class='post entry content'>", "</div>"), ("<section class='story text'>", "</section>"), ("<div itemprop='articleBody'>", "</div>"), ("<div class='page'><div class='wrapper'>", "</div></div>"), ("<table><tr><td>", "</td></tr></table>"), ("<div>", "</div>"), ("<div id='b'>", "</div>"), ("", ""),
]
#: What pages say around articles, by the kind of place.
SAYINGS = {
    "menu": ["Home", "About us", "Contact", "News", "Most read", "Related articles", "Read more", "See also", "Share this", "Next post", "Previous post", "Tags", "Categories", "Archive", "Sitemap", "Popular posts", "Trending now", "You may also like", "Skip to content", "Back to top", "Menu"],
    "title": ["Welcome", "Official site", "Sign in", "Search", "Menu"],
    "legal": ["All rights reserved", "Terms of use", "Privacy policy", "Copyright", "Imprint", "Powered by", "Terms and conditions"],
    "form": ["Search", "Email", "Password", "Log in", "Sign up", "Submit", "Subscribe to our newsletter", "Send", "Leave a reply", "Post comment"],
    "comment": ["Comments", "Reply", "Posted by", "says", "Leave a comment", "1 comment", "Anonymous wrote", "Nice post", "Thanks for sharing", "Great article", "I agree"],
    "teaser": ["Advertisement", "Sponsored", "We use cookies", "Accept cookies", "Subscribe now", "Newsletter", "Most read", "Special offer", "Follow us", "Sale", "Buy now", "Sign up for our newsletter", "Recommended", "This site uses cookies", "Click here", "Promotion"],
    "none": [],
}
#: The words of SAYINGS that are worth a feature.
CUES = {w for said in SAYINGS.values() for x in said for w in WORD.findall(x.lower())} - {"to", "for", "of", "and", "a", "i", "us", "our", "this", "by", "in", "on", "up", "we", "you", "may", "now", "great", "back", "next", "post", "see", "more", "here", "send", "all", "out", "about", "top", "use", "site", "uses", "nice"}


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def _sentence(rng: random.Random, n: int) -> str:
    return _words(rng, n).capitalize() + rng.choice("....!?")


def _said(rng: random.Random, kind: str, text: str, often: float) -> str:
    """text, or what such places say with or without it."""
    said = SAYINGS[kind]
    if not said or rng.random() > often:
        return text
    one = rng.choice(said)
    return rng.choice([one, f"{one}: {text}", f"{one} {text}", f"{text} {one}"])


def _frame(rng: random.Random, kind: str, often: float = 0.4) -> str:
    say = lambda text: _said(rng, kind, text, often)
    if kind == "menu":
        links = [f"<a href='/{_words(rng, 1)}'>{say(_words(rng, rng.randint(1, 3)))}</a>" for _ in range(rng.randint(2, 8))]
        head = f"<h3>{say(_words(rng, rng.randint(1, 3)))}</h3>" if rng.random() < 0.3 else ""
        return head + rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", " | ".join(links), "".join(f"<div>{x}</div>" for x in links), "".join(f"<p>{x}</p>" for x in links)])
    if kind == "title":
        return rng.choice(["<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>", "{}"]).format(say(_words(rng, rng.randint(1, 6))))
    if kind == "legal":
        return rng.choice(["&copy; {}", "Copyright {}", "<p>{}</p>", "{}"]).format(say(_words(rng, 2) + " &middot; " + _sentence(rng, rng.randint(2, 30))))
    if kind == "form":
        return f"<label>{say(_words(rng, 2))}</label><input name=q>" + rng.choice(["", f"<p>{say(_sentence(rng, rng.randint(3, 20)))}</p>"]) + f"<button>{say(_words(rng, 1))}</button>"
    if kind == "comment":
        one = lambda: rng.choice(["<p>{}</p>", "<div class='comment'>{}</div>", "<li>{}</li>", "{}<br>", "<h3>{}</h3>"]).format(say(_sentence(rng, rng.randint(2, 60))))
        return "".join(one() for _ in range(rng.randint(1, 4)))
    if kind == "teaser":
        return rng.choice(["{}", "<p>{}</p>", "<h3>{}</h3>", "<ul><li>{}</li></ul>"]).format(say(_sentence(rng, rng.randint(1, 60))))
    return ""


def _boilerplate(rng: random.Random, frames: list) -> str:
    """One place of boilerplate. In a place whose name says nothing, what stands there always says something."""
    if rng.random() < 0.2:
        opening, closing = rng.choice(BARE)
        kind = rng.choice(["menu", "comment", "teaser", "legal"])
        one = rng.choice(SAYINGS[kind])
        return opening + rng.choice([f"<h3>{one}</h3>", one, f"{one}: {_words(rng, rng.randint(1, 8))}", f"{one} {_words(rng, rng.randint(1, 4))}", _frame(rng, kind, 1.0)]) + closing
    opening, closing, kind = rng.choice(frames)
    return opening + _frame(rng, kind) + closing


def _article(rng: random.Random, inside: bool, frames: list) -> list[tuple[str, int]]:
    """(markup, label) in order; inside: whether boilerplate may stand inside the article."""
    parts = [(rng.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<h1 class='title'>{}</h1>"]).format(_words(rng, rng.randint(1, 10))), 1)] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 9)):
        size = rng.choice([1, 2, 4, 8, 15, 30, 60, 100])
        text = _sentence(rng, size) if rng.random() < 0.9 else _words(rng, size)
        if size > 8 and rng.random() < 0.15:  # articles use these words too
            text = text.replace(" ", f" {rng.choice(sorted(CUES))} ", 1)
        if rng.random() < 0.15:
            text = text.replace(" ", " <a href='#x'>", 1) + "</a>" if " " in text else text
        if rng.random() < 0.05 and " " in text:
            text = text.replace(" ", f" <button>{_words(rng, 1)}</button> ", 1)
        parts.append((rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<h3>{}</h3>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<ol><li>{}</li></ol>", "<div>{}</div>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>", "<section><p>{}</p></section>", "{}<br>"]).format(text), 1))
        if inside and rng.random() < 0.2:
            opening, closing, kind = rng.choice(frames)
            parts.append((opening + _frame(rng, kind) + closing, 0))
        if inside and rng.random() < 0.05:
            parts.append((f"<div><button>{_words(rng, rng.randint(1, 2))}</button></div>", 0))
    return parts


def training_pages(count: int = 2000, seed: int = 3, frames: list = FRAMES, holders: list = HOLDERS) -> list[tuple[str, list[int]]]:
    """Generated pages with the label of each of their blocks (1: article). Layouts vary; no real page is used."""
    rng, out = random.Random(seed), []
    while len(out) < count:
        if rng.random() < 0.04:  # bare text
            out.append((_sentence(rng, rng.randint(1, 80)), [1]))
            continue
        around = lambda: [(_boilerplate(rng, frames), 0) for _ in range(rng.randint(0, 4))]
        opening, closing = rng.choice(holders)
        body = around() + [(opening, None)] + _article(rng, rng.random() < 0.6, frames) + [(closing, None)] + around()
        page, labels, before = "<html><head><title>t</title></head><body>", [], 0
        for markup, label in body:
            page += markup
            grown = len(blocks(page))
            if label is not None:
                labels += [label] * (grown - before)
            before = grown
        if len(labels) == len(blocks(page)) and labels:
            out.append((page, labels))
    return out


# -- the field


class Field:
    """Weights of a two-label chain: per feature and label, per label pair, and for the first label."""

    def __init__(self, weights: dict[str, tuple[float, float]], pairs: list[list[float]]):
        self.weights, self.pairs = weights, pairs

    def unary(self, rows: list[list[str]]) -> list[tuple[float, float]]:
        get, zero = self.weights.get, (0.0, 0.0)
        out = []
        for row in rows:
            a = b = 0.0
            for f in row:
                w = get(f, zero)
                a += w[0]
                b += w[1]
            out.append((a, b))
        return out

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks; ties go to label 0."""
        if not rows:
            return []
        (p00, p01), (p10, p11) = self.pairs
        scores = self.unary(rows)
        (s0, s1), back = scores[0], []
        for u0, u1 in scores[1:]:
            from0, from1 = s1 + p10 > s0 + p00, s1 + p11 > s0 + p01
            back.append((from0, from1))
            s0, s1 = (s1 + p10 if from0 else s0 + p00) + u0, (s1 + p11 if from1 else s0 + p01) + u1
        label = int(s1 > s0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train_field(pages: list[tuple[str, list[int]]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-4, rare: int = 3) -> Field:
    """Maximum likelihood by full-batch adaptive gradient ascent; forward-backward runs over all pages at once."""
    rows = [features(blocks(p)) for p, _ in pages]
    counts: dict[str, int] = {}
    for page in rows:
        for row in page:
            for f in row:
                counts[f] = counts.get(f, 0) + 1
    index = {f: k for k, f in enumerate(sorted(f for f, n in counts.items() if n >= rare))}
    longest, n = max(map(len, rows)), len(rows)
    mask, gold = np.zeros((n, longest)), np.zeros((n, longest), np.int64)
    slot, column = [], []
    for i, (page, (_, labels)) in enumerate(zip(rows, pages)):
        mask[i, : len(page)], gold[i, : len(page)] = 1, labels
        for t, row in enumerate(page):
            for f in row:
                if f in index:
                    slot.append(i * longest + t)
                    column.append(index[f])
    slot, column = np.array(slot), np.array(column)
    w, pairs = np.zeros((len(index), 2)), np.zeros((2, 2))
    seen_w, seen_p = np.full_like(w, 1e-8), np.full_like(pairs, 1e-8)
    truth = np.eye(2)[gold] * mask[:, :, None]
    for _ in range(rounds):
        unary = np.stack([np.bincount(slot, w[column, y], n * longest) for y in (0, 1)], 1).reshape(n, longest, 2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = unary[:, 0]
        for t in range(1, longest):
            step = unary[:, t] + np.logaddexp(forward[:, t - 1, 0, None] + pairs[0], forward[:, t - 1, 1, None] + pairs[1])
            forward[:, t] = np.where(mask[:, t, None] > 0, step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = unary[:, t + 1] + backward[:, t + 1]
            step = np.logaddexp(ahead[:, 0, None] + pairs[:, 0], ahead[:, 1, None] + pairs[:, 1])
            backward[:, t] = np.where(mask[:, t + 1, None] > 0, step, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        prob = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        difference = (truth - prob).reshape(-1, 2)
        grad_w = np.stack([np.bincount(column, difference[slot, y], len(index)) for y in (0, 1)], 1) - decay * n * w
        grad_p = -decay * n * pairs
        both = mask[:, 1:] * mask[:, :-1]
        for a in (0, 1):
            for b in (0, 1):
                expected = np.exp(forward[:, :-1, a] + pairs[a, b] + unary[:, 1:, b] + backward[:, 1:, b] - total[:, None]) * both
                grad_p[a, b] += (truth[:, :-1, a] * truth[:, 1:, b]).sum() - expected.sum()
        seen_w += grad_w**2
        seen_p += grad_p**2
        w += rate * grad_w / np.sqrt(seen_w)
        pairs += rate * grad_p / np.sqrt(seen_p)
    return Field({f: (float(w[k, 0]), float(w[k, 1])) for f, k in index.items()}, pairs.tolist())


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    return train_field(training_pages())


def extract(page: str | None, field: Field) -> str:
    """The article's blocks joined by single spaces; empty for null, empty and text-less pages."""
    found = blocks(page or "")
    return " ".join(b[0] for b, y in zip(found, field.viterbi(features(found, field.weights))) if y)


def _extract(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, field) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text (the article), n_chars (its code points).

    Null and empty pages give the empty text; pages of any length are read whole; repeated rows get equal results; an
    empty table gives an empty result; other columns of pages are not looked at.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(field or default_field()), "page_id bigint, url string, text string, n_chars bigint")
