"""Chat formatting: a small sandboxed template language, compiled to Python closures.

``{{ expression }}``, ``{% for x in list %}``, ``{% if %} {% elif %} {% else %}``, ``{% set name = expression %}`` and
``{% generation %} ... {% endgeneration %}``, which marks what the assistant generates. A ``-`` inside a tag trims white
space on that side. Expressions: strings, numbers, true, false, none, names, ``a.b`` and ``a['b']`` on mappings and
lists, ``~`` and ``+``, comparisons, ``in``, ``not and or``, ``a if c else b`` and filters (``| trim``). There are no
calls and no Python attributes, so a template can reach only the values it is given.

The source is parsed into a tree, constant parts of which are folded, and every node becomes a closure.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- control strings in texts

#: Strings that steer chat models; a text may not hold them unescaped.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    """text with backslashes doubled and a backslash behind the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_line(text: str) -> str:
    """escape(), and a backslash before every line feed: the result ends at the first line feed without one."""
    return escape(text).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _length(value) -> int:
    """Members of a list or mapping; characters of anything else as text."""
    return len(value) if isinstance(value, (list, tuple, dict, Turns)) else len(_text(value))


def _of_text(use: Callable[[str], str]) -> Callable:
    return lambda value: use(_text(value))


FILTERS: dict[str, Callable] = {"trim": _of_text(str.strip), "upper": _of_text(str.upper), "lower": _of_text(str.lower), "length": _length, "escape": _of_text(escape), "escape_line": _of_text(escape_line), "string": _of_text(str)}


class TemplateError(ValueError):
    """The template is not in the language."""


# -- parsing: nodes are tuples, their first member the kind

_STRING = r"'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\""
#: Tags end at the first end sign outside of string literals.
_TAG = re.compile(rf"\{{\{{(-?)((?:{_STRING}|(?!-?\}}\}})[^'\"])*+)(-?)\}}\}}|\{{%(-?)((?:{_STRING}|(?!-?%\}})[^'\"])*+)(-?)%\}}|\{{#.*?#\}}", re.S)
_LEXEME = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[-+~<>|.()\[\],]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


class _Expression:
    def __init__(self, source: str):
        self.items, at, source = [], 0, source.strip()
        while at < len(source):
            m = _LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            number, name, string, sign = m.groups()
            if string:
                string = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)
            self.items.append(("number", int(number)) if number else ("name", name) if name else ("string", string) if m[3] else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] in ("sign", "name") and self.items[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self) -> tuple:
        node = self.choice()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else ("const", "")
            return ("choice", test, node, other)
        return node

    def _left(self, below: Callable, signs: tuple) -> tuple:
        node = below()
        while sign := self.take(*signs):
            node = ("binary", sign, node, below())
        return node

    def either(self) -> tuple:
        return self._left(self.both, ("or",))

    def both(self) -> tuple:
        return self._left(self.negation, ("and",))

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        node = self.joined()
        if sign := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            return ("binary", sign, node, self.joined())
        return node

    def joined(self) -> tuple:
        return self._left(self.filtered, ("~", "+"))

    def filtered(self) -> tuple:
        node = self.primary()
        while self.take("|"):
            kind, name = self.items[self.at] if self.at < len(self.items) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            self.at += 1
            node = ("filter", name, node)
        return node

    def primary(self) -> tuple:
        if self.at >= len(self.items):
            raise TemplateError("an expression ends early")
        kind, value = self.items[self.at]
        self.at += 1
        if kind in ("number", "string"):
            node = ("const", value)
        elif kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            node = ("const", fixed[value]) if value in fixed else ("name", value)
        elif value == "(":
            node = self.choice()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while sign := self.take(".", "["):
            if sign == ".":
                kind, key = self.items[self.at] if self.at < len(self.items) else ("", "")
                if kind != "name":
                    raise TemplateError("a name must follow the dot")
                self.at += 1
                node = ("item", node, ("const", key))
            else:
                node = ("item", node, self.choice())
                self.need("]")
        return node


def _plain(text: str) -> str:
    """text, which may not start a tag: one that starts here is not closed."""
    if found := re.search(r"\{[{%#]", text):
        raise TemplateError(f"{found[0]!r} is not closed")
    return text


def parse(source: str) -> tuple:
    """The syntax tree of a template: ("block", nodes)."""
    pieces, at, trim = [], 0, False
    for m in _TAG.finditer(source):
        text = _plain(source[at : m.start()])
        text = text.lstrip() if trim else text
        left, right = m[1] or m[4], m[3] or m[6]
        pieces.append(("text", text.rstrip() if left else text))
        if m[2] is not None:
            pieces.append(("output", m[2]))
        elif m[5] is not None:
            pieces.append(("tag", m[5].strip()))
        at, trim = m.end(), bool(right)
    rest = _plain(source[at:])
    pieces.append(("text", rest.lstrip() if trim else rest))
    position = 0

    def block(ends: tuple) -> tuple[tuple, str]:
        nonlocal position
        nodes: list = []
        while position < len(pieces):
            kind, value = pieces[position]
            position += 1
            if kind == "text":
                nodes.append(("const", value))
            elif kind == "output":
                nodes.append(("output", _Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return ("block", nodes), value
                nodes.append(tag(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", nodes), ""

    def tag(word: str, rest: str) -> tuple:
        if word == "for":
            name, _, items = rest.strip().partition(" in ")
            if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"can't loop over {rest!r}")
            return ("for", name.strip(), _Expression(items).whole(), block(("endfor",))[0])
        if word == "if":
            body, end = block(("elif", "else", "endif"))
            test = _Expression(rest).whole()
            if end.startswith("elif"):
                return ("if", test, body, ("block", [tag("if", end[4:])]))
            return ("if", test, body, block(("endif",))[0] if end == "else" else ("block", []))
        if word == "set":
            name, sign, value = rest.partition("=")
            if not sign:
                raise TemplateError(f"can't set {rest!r}")
            return ("set", name.strip(), _Expression(value).whole())
        if word == "generation":
            return ("generation", block(("endgeneration",))[0])
        raise TemplateError(f"there is no tag {word!r}")

    return block(())[0]


# -- folding


def _binary(sign: str, a, b):
    try:
        return _operate(sign, a, b)
    except TypeError as e:
        raise TemplateError(f"{sign!r} does not take these values: {e}") from e


def _operate(sign: str, a, b):
    if sign in ("+", "~"):
        return a + b if sign == "+" and not isinstance(a, str) and not isinstance(b, str) else _text(a) + _text(b)
    if sign == "==":
        return a == b
    if sign == "!=":
        return a != b
    if sign == "in":
        return a in (b or ())
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[sign]


def _text(value) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


def fold(node: tuple) -> tuple:
    """The tree with constant expressions evaluated, constant branches chosen and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "block":
        out: list = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "const" and out and out[-1][0] == "const":
                    out[-1] = ("const", out[-1][1] + _text(y[1]))
                elif y != ("const", ""):
                    out.append(("const", _text(y[1])) if y[0] == "const" else y)
        return ("block", out)
    if kind == "output":
        inner = fold(node[1])
        return ("const", _text(inner[1])) if inner[0] == "const" else ("output", inner)
    if kind == "filter":
        inner = fold(node[2])
        return ("const", FILTERS[node[1]](inner[1])) if inner[0] == "const" else ("filter", node[1], inner)
    if kind == "not":
        inner = fold(node[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "binary":
        sign, a, b = node[1], fold(node[2]), fold(node[3])
        if sign in ("and", "or") and a[0] == "const":
            return b if bool(a[1]) == (sign == "and") else a
        if a[0] == b[0] == "const" and sign not in ("and", "or"):
            return ("const", _binary(sign, a[1], b[1]))
        return ("binary", sign, a, b)
    if kind == "choice":
        test, a, b = map(fold, node[1:])
        return (a if test[1] else b) if test[0] == "const" else ("choice", test, a, b)
    if kind == "if":
        test, a, b = map(fold, node[1:])
        return (a if test[1] else b) if test[0] == "const" else ("if", test, a, b)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "item":
        return ("item", fold(node[1]), fold(node[2]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    return ("generation", fold(node[1]))


# -- closures


def _item(value, key):
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, Turns)) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return None


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, k=node[1]: scope.get(k)
    if kind == "item":
        of, key = _value(node[1]), _value(node[2])
        return lambda scope: _item(of(scope), key(scope))
    if kind == "filter":
        use, of = FILTERS[node[1]], _value(node[2])
        return lambda scope: use(of(scope))
    if kind == "not":
        of = _value(node[1])
        return lambda scope: not of(scope)
    if kind == "choice":
        test, a, b = map(_value, node[1:])
        return lambda scope: a(scope) if test(scope) else b(scope)
    sign, a, b = node[1], _value(node[2]), _value(node[3])
    if sign == "and":
        return lambda scope: a(scope) and b(scope)
    if sign == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope: _binary(sign, a(scope), b(scope))


class Turns:
    """Messages that are read when a template asks for them; ``forget``: each is read once and not kept."""

    def __init__(self, source: Iterator, forget: bool = False):
        self.source, self.forget, self.held = source, forget, []

    def __iter__(self) -> Iterator:
        if self.forget:
            return self.source
        return iter(self._all())

    def _all(self) -> list:
        self.held += self.source
        return self.held

    def __len__(self) -> int:
        return len(self._all())

    def __getitem__(self, k):
        return self._all()[k]


#: What a template writes: a text, the start and the end of a generated part, or a place between two messages.
MARK, UNMARK, BETWEEN = object(), object(), object()
Writer = Callable[[dict], Iterator]


def _writer(node: tuple) -> Writer:
    kind = node[0]
    if kind == "block":
        parts = [_writer(x) for x in node[1]]

        def run(scope: dict) -> Iterator:
            for part in parts:
                yield from part(scope)

        return run
    if kind == "const":
        fixed = (_text(node[1]),)
        return lambda scope: fixed
    if kind == "output":
        of = _value(node[1])
        return lambda scope: (_text(of(scope)),)
    if kind == "set":
        of = _value(node[2])

        def put(scope: dict) -> Iterator:
            scope[node[1]] = of(scope)
            return ()

        return put
    if kind == "if":
        test, a, b = _value(node[1]), _writer(node[2]), _writer(node[3])
        return lambda scope: a(scope) if test(scope) else b(scope)
    if kind == "generation":
        body = _writer(node[1])

        def mark(scope: dict) -> Iterator:
            yield MARK
            yield from body(scope)
            yield UNMARK

        return mark
    items, body, name = _value(node[2]), _writer(node[3]), node[1]

    def loop(scope: dict) -> Iterator:
        given = items(scope)
        ahead = iter(given if isinstance(given, (list, tuple, str, dict, Turns)) else ())
        at, item = 0, next(ahead, MARK)
        while item is not MARK:
            after = next(ahead, MARK)
            yield from body(scope | {name: item, "loop": {"index0": at, "index": at + 1, "first": at == 0, "last": after is MARK}})
            if isinstance(given, Turns):
                yield BETWEEN
            at, item = at + 1, after

    return loop


def _uses(node, name: str, looped: bool = False) -> list[bool]:
    """For each use of the name: whether it is the list of a loop that itself stands in no loop."""
    if not isinstance(node, (tuple, list)) or not node or node[0] == "const":
        return []
    if isinstance(node, tuple) and node[0] == "name":
        return [False] if node[1] == name else []
    if isinstance(node, tuple) and node[0] == "for":
        own = [not looped] if node[2] == ("name", name) else _uses(node[2], name, looped)
        return own + _uses(node[3], name, True)
    return [u for x in node for u in _uses(x, name, looped)]


class Template:
    """A compiled template; ``render(values)`` gives (text, spans under generation markers)."""

    def __init__(self, source: str):
        try:
            self.tree = fold(parse(source))
            self._write = _writer(self.tree)
            #: Whether the messages are looped over once and used nowhere else, so that they can be forgotten.
            self.streams = _uses(self.tree, "messages") == [True]
        except RecursionError as e:
            raise TemplateError("the template is nested too deeply") from e

    def events(self, values: dict) -> Iterator:
        """What the template writes, in order: texts, MARK, UNMARK and BETWEEN."""
        try:
            yield from self._write(dict(values))
        except RecursionError as e:
            raise TemplateError("the template is nested too deeply") from e

    def segments(self, values: dict, most_turns: int | None = None, most_chars: int | None = None) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """One rendering in pieces (text, spans), cut between messages where one has got that long."""
        pieces, length, spans, starts, turns = [], 0, [], [], 0
        for e in self.events(values):
            if e is MARK:
                starts.append(length)
            elif e is UNMARK:
                spans.append((starts.pop(), length))
            elif e is BETWEEN:
                turns += 1
                if not starts and ((most_turns and turns >= most_turns) or (most_chars and length >= most_chars)):
                    yield "".join(pieces), spans
                    pieces, length, spans, turns = [], 0, [], 0
            else:
                pieces.append(e)
                length += len(e)
        if pieces or spans:
            yield "".join(pieces), spans

    def render(self, values: dict) -> tuple[str, list[tuple[int, int]]]:
        return next(self.segments(values), ("", []))


START, END = "<|im_start|>", "<|im_end|>"
#: Turns as START role LF text END LF; the assistant's texts alone are generated.
CHAT_TEMPLATE = (
    "{% set start = '<|im_' ~ 'start|>' %}{% for m in messages %}{{ start }}{{ m.role | escape_line }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|im_end|>{{ '\\n' }}{% endfor %}"
)
#: Turns and characters of an output row, from which on the next begins; the rendering goes on over all of them.
SEGMENT_TURNS, SEGMENT_CHARS = 64, 1_000_000

FORMATTED = "conv_id bigint, segment bigint, text string, mask array<struct<start:bigint,end:bigint>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, its messages) of sorted rows; messages that were not asked for are passed over."""
    rows = ((c, {"role": role or "", "text": text or ""}) for batch in batches for c, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))))
    return ((conv, (m for _, m in mine)) for conv, mine in itertools.groupby(rows, key=lambda r: r[0]))


def _format(source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, held, size = Template(source), [], 0
        for conv, messages in _conversations(batches):
            turns = Turns(messages, forget=template.streams)
            for n, (text, spans) in enumerate(template.segments({"messages": turns}, SEGMENT_TURNS, SEGMENT_CHARS)):
                held.append({"conv_id": conv, "segment": n, "text": text, "mask": [{"start": a, "end": b} for a, b in spans]})
                size += len(text)
                if size >= SEGMENT_CHARS:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)

    return run


def format_conversations(conversations: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """Formatted conversations in segments: conv_id, segment (from 0), text, mask (spans of text in code points).

    Rows of a conversation are taken by turn, nulls first; ties by role and text. They stream through one sorted
    partition and one rendering, whose text is the segments' in order. A template that loops over ``messages`` once and
    uses them nowhere else needs the memory of one segment, however long a conversation is; any other holds the
    messages of one conversation.
    Null texts and roles count as empty; rows without conv_id are a conversation of their own; repeated rows are turns
    of their own; an empty table gives an empty result; other columns are not looked at.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(template), FORMATTED)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("a turn must start here")
        line = re.compile(r"(?:\\.|[^\\\n])*", re.S).match(text, at + len(START))
        end = text.index(END, line.end())
        out.append((unescape(line[0]), unescape(text[line.end() + 1 : end])))
        at = end + len(END) + 1
    return out


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    conv, n, turns, chars, loss, size = None, 0, None, 0, None, 0

    def close() -> tuple:
        return (conv[0], n, turns.hexdigest(), chars, loss.hexdigest(), size)

    def table(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        rows = []
        for conv_id, text, mask in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            if conv != (conv_id,):
                if conv:
                    rows.append(close())
                conv, n, turns, chars, loss, size = (conv_id,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            for role, said in read_turns(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for span in mask:
                said = unescape(text[span["start"] : span["end"]])
                loss.update(said.encode())
                chars += len(said)
            size += len(text)
        if rows:
            yield table(rows)
    if conv:
        yield table([close()])


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted segments say when read back; segments must come together and in order."""
    return formatted.mapInArrow(_digest, DIGEST)
