"""A template compiler for chat formats.

A small sandboxed language is parsed into a syntax tree, constants in it are folded, and the tree becomes Python closures:

    {{ expression }}                          output
    {% for m in messages %} … {% endfor %}    m and loop.index0, loop.first, loop.last
    {% if a %} … {% elif b %} … {% else %} … {% endif %}
    {% set name = expression %}
    {% generation %} … {% endgeneration %}    what is written here carries the training loss
    {# comment #}

Expressions have strings, integers, true, false, none, names, ``a.b`` and ``a['b']`` (keys of mappings and places of lists only),
``~`` and ``+``, ``-``, ``==`` ``!=`` ``<`` ``<=`` ``>`` ``>=``, ``and`` ``or`` ``not``, parentheses, and the filters named in FILTERS.
There is no call, no import, no attribute of a Python object and no loop other than over a list, so a template can only read the
conversation and ends after as many steps as that has turns.

``controls`` are the strings that mark turns in the output. The filter ``escape`` puts a backslash before every backslash
and before every place of a text where a control string begins, or where the text ends inside one; ``unescape`` takes them off.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


class TemplateError(ValueError):
    pass


# -- escaping --------------------------------------------------------------------------------------------------------


def escaper(controls: tuple[str, ...]) -> Callable[[object], str]:
    begun = sorted({c[:n] for c in controls for n in range(1, len(c))}, key=len, reverse=True)
    pattern = re.compile("|".join([r"\\", *map(re.escape, controls), *(re.escape(b) + r"\Z" for b in begun)]))

    def escape(value: object) -> str:
        text, out, at = _text(value), [], 0
        while match := pattern.search(text, at):  # a control string may begin inside another one
            out += [text[at:match.start()], "\\", text[match.start()]]
            at = match.start() + 1
        return "".join(out) + text[at:]

    return escape


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


# -- syntax ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    base: object
    key: object


@dataclass(frozen=True)
class Unary:
    op: str
    value: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    name: str
    value: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


def _text(value: object) -> str:
    return "" if value is None else {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list)) else 0, "string": _text,
}

OPERATORS: dict[str, Callable] = {
    "~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b,
}

_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>().\[\]|=]))")
_TAG = re.compile(r"\{\{(?P<out>.*?)\}\}|\{%-?(?P<tag>.*?)-?%\}|\{#.*?#\}", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            match = _TOKEN.match(source, at)
            if not match:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((match.lastgroup, match[match.lastgroup]))
            at = match.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return value if kind in ("op", "name") else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r}")

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self):
        value = self.either()
        self.end()
        return value

    def either(self):
        value = self.both()
        while self.take("or"):
            value = Binary("or", value, self.both())
        return value

    def both(self):
        value = self.negated()
        while self.take("and"):
            value = Binary("and", value, self.negated())
        return value

    def negated(self):
        return Unary("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        value = self.added()
        while op := self.take("==", "!=", "<", "<=", ">", ">="):
            value = Binary(op, value, self.added())
        return value

    def added(self):
        value = self.filtered()
        while op := self.take("+", "-", "~"):
            value = Binary(op, value, self.filtered())
        return value

    def filtered(self):
        value = self.reached()
        while self.take("|"):
            value = Filter(self.word(), value)
        return value

    def reached(self):
        value = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                value = Item(value, Const(self.word()))
            else:
                value = Item(value, self.either())
                self.need("]")
        return value

    def atom(self):
        if self.take("("):
            value = self.either()
            self.need(")")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    parts, at = [], 0
    for match in _TAG.finditer(source):
        if match.start() > at:
            parts.append(("text", source[at:match.start()]))
        at = match.end()
        if match["out"] is not None:
            parts.append(("out", match["out"]))
        elif match["tag"] is not None:
            parts.append(("tag", match["tag"].strip()))
    if at < len(source):
        parts.append(("text", source[at:]))
    place = 0

    def block(*ends: str) -> tuple[tuple, str | None]:
        nonlocal place
        body = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind != "tag":
                body.append(Output(Const(value) if kind == "text" else _Expression(value).whole()))
                continue
            word = value.split(None, 1)[0] if value else ""
            if word in ends:
                return tuple(body), value
            body.append(statement(word, value[len(word):]))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(body), None

    def branch(test: str) -> If:
        condition = _Expression(test).whole()
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return If(condition, then, (branch(end[4:]),))
        return If(condition, then, block("endif")[0] if end == "else" else ())

    def statement(word: str, rest: str):
        if word == "if":
            return branch(rest)
        if word == "for":
            line = _Expression(rest)
            name = line.word()
            line.need("in")
            over = line.whole()
            return For(name, over, block("endfor")[0])
        if word == "set":
            line = _Expression(rest)
            name = line.word()
            line.need("=")
            return Set(name, line.whole())
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


# -- folding ---------------------------------------------------------------------------------------------------------


def fold(node, filters: dict[str, Callable]):
    """The tree with constant expressions computed, branches that are never taken cut, and texts side by side joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in (y for n in node for y in (lambda f: f if isinstance(f, tuple) else (f,))(fold(n, filters))):
            if isinstance(x, Output) and isinstance(x.value, Const):
                text = _text(x.value.value)
                if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    out[-1] = Output(Const(out[-1].value.value + text))
                elif text:
                    out.append(Output(Const(text)))
            else:
                out.append(x)
        return tuple(out)
    if isinstance(node, Output):
        return Output(fold(node.value, filters))
    if isinstance(node, If):
        test = fold(node.test, filters)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, filters)
        return If(test, fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        value = fold(node.value, filters)
        return Const(filters[node.name](value.value)) if isinstance(value, Const) else Filter(node.name, value)
    if isinstance(node, Unary):
        value = fold(node.value, filters)
        return Const(not value.value) if isinstance(value, Const) else Unary(node.op, value)
    if isinstance(node, Item):
        return Item(fold(node.base, filters), fold(node.key, filters))
    if isinstance(node, Binary):
        left, right = fold(node.left, filters), fold(node.right, filters)
        if isinstance(left, Const) and node.op in ("and", "or"):
            return (right if left.value else left) if node.op == "and" else (left if left.value else right)
        if isinstance(left, Const) and isinstance(right, Const):
            try:
                return Const(OPERATORS[node.op](left.value, right.value))
            except TypeError as error:
                raise TemplateError(str(error)) from error
        return Binary(node.op, left, right)
    return node


# -- closures --------------------------------------------------------------------------------------------------------


def _value(node, filters: dict[str, Callable]) -> Callable[[dict], object]:
    if isinstance(node, Const):
        constant = node.value
        return lambda env: constant
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        base, key = _value(node.base, filters), _value(node.key, filters)

        def item(env):
            holder, at = base(env), key(env)
            if isinstance(holder, dict):
                return holder.get(at)
            if isinstance(holder, list) and isinstance(at, int) and not isinstance(at, bool):
                return holder[at] if -len(holder) <= at < len(holder) else None
            return None

        return item
    if isinstance(node, Filter):
        apply, value = filters[node.name], _value(node.value, filters)
        return lambda env: apply(value(env))
    if isinstance(node, Unary):
        value = _value(node.value, filters)
        return lambda env: not value(env)
    left, right = _value(node.left, filters), _value(node.right, filters)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)
    apply = OPERATORS[node.op]

    def binary(env):
        try:
            return apply(left(env), right(env))
        except TypeError as error:
            raise TemplateError(str(error)) from error

    return binary


class _Sink:
    """What is written, and the spans of generation blocks in code points."""

    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _block(nodes: tuple, filters: dict[str, Callable]) -> Callable[[dict, _Sink], None]:
    steps = [_step(n, filters) for n in nodes]

    def run(env: dict, sink: _Sink) -> None:
        for step in steps:
            step(env, sink)

    return run


def _step(node, filters: dict[str, Callable]) -> Callable[[dict, _Sink], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text = _text(node.value.value)
            return lambda env, sink: sink.write(text)
        value = _value(node.value, filters)
        return lambda env, sink: sink.write(_text(value(env)))
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _block(node.then, filters), _block(node.other, filters)
        return lambda env, sink: (then if test(env) else other)(env, sink)
    if isinstance(node, Set):
        name, value = node.name, _value(node.value, filters)
        return lambda env, sink: env.__setitem__(name, value(env))
    if isinstance(node, Generation):
        body = _block(node.body, filters)

        def generation(env, sink):
            start = sink.size
            body(env, sink)
            sink.spans.append((start, sink.size))

        return generation
    name, over, body = node.name, _value(node.over, filters), _block(node.body, filters)

    def loop(env, sink):
        values = over(env)
        if not isinstance(values, list):
            raise TemplateError(f"{name} cannot run over a {type(values).__name__}")
        inner = dict(env)
        for k, value in enumerate(values):
            inner[name], inner["loop"] = value, {"index0": k, "first": k == 0, "last": k == len(values) - 1}
            body(inner, sink)

    return loop


def _constants(node) -> Iterator[str]:
    """All text that the template itself may write."""
    if isinstance(node, tuple):
        for n in node:
            yield from _constants(n)
    elif isinstance(node, Output) and isinstance(node.value, Const):
        yield _text(node.value.value)
    elif hasattr(node, "__dataclass_fields__"):
        for field in node.__dataclass_fields__:
            yield from _constants(getattr(node, field))


def compile_template(source: str, controls: tuple[str, ...] = ()) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to (text, spans of generation blocks).

    Refused is a template one of whose own texts ends inside a control string, since a conversation's text could
    complete it.
    """
    filters = FILTERS | ({"escape": escaper(controls)} if controls else {})
    tree = fold(parse(source), filters)
    for text in _constants(tree):
        for control in controls:
            for n in range(1, len(control)):
                if text.endswith(control[:n]) and not any(text.endswith(c) for c in controls):
                    raise TemplateError(f"{text!r} ends inside {control!r}")
    body = _block(tree, filters)

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        sink = _Sink()
        body(dict(variables), sink)
        return "".join(sink.parts), sink.spans

    return render


# -- conversations ---------------------------------------------------------------------------------------------------

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]")
TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}[SYS]{{ m.text | escape }}[/SYS]"
    "{% else %}[ROLE]{{ m.role | escape }}[TEXT]{{ m.text | escape }}[/ROLE]"
    "{% endif %}{% endfor %}")
_MARK = re.compile(r"\\.|" + "|".join(re.escape(c) for c in CONTROLS), re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a conversation that TEMPLATE has written."""
    turns, at = [], len("<s>")
    begin, kind, role = at, "assistant", None
    for match in _MARK.finditer(text, at):
        mark = match[0]
        if mark[0] == "\\":
            continue
        if mark in ("[INST]", "[SYS]", "[ROLE]"):
            kind, begin = {"[INST]": "user", "[SYS]": "system", "[ROLE]": "role"}[mark], match.end()
        elif mark == "[TEXT]":
            role, begin = unescape(text[begin:match.start()]), match.end()
        else:
            turns.append((role if kind == "role" else kind, unescape(text[begin:match.start()])))
            kind, begin = "assistant", match.end()
    return turns


def _format(template: str, controls: tuple[str, ...]):
    def run(batches):
        render = compile_template(template, controls)
        for batch in batches:
            found = [render({"messages": [{"role": t["role"], "text": t["text"]} for t in turns]}) for turns in batch.column("turns").to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([t for t, _ in found], pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv_id", "formatted", "loss_spans"])

    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, id_col: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation, its turns in order of ``turn``.

    ``loss_spans`` are the code points (start, end) of ``formatted`` inside generation blocks. A conversation is one value of
    the result, so its turns meet in one task, and no other turns with them.

    Defined results: very long texts are formatted whole;
    a null text or role is an empty one; turns of equal number are ordered by role and text, a null number
    comes first, and repeated rows are turns of their own; rows without a conversation's id are one conversation with a
    null id; an empty table gives an empty table; other columns are not read.
    """
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    kind = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, formatted string, loss_spans array<struct<start:long,end:long>>"
    return whole.mapInArrow(_format(template, controls), kind)


def _read(batches):
    for batch in batches:
        texts, spans = batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()
        turns = [[{"role": r, "text": t} for r, t in read_back(x)] for x in texts]
        loss = ["".join(unescape(x[s["start"]:s["end"]]) for s in found) for x, found in zip(texts, spans)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
             pa.array(loss, pa.string()), batch.column("formatted")], ["conv_id", "turns", "loss_text", "formatted"])


def read_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): what TEMPLATE has written, taken apart again."""
    kind = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, turns array<struct<role:string,text:string>>, loss_text string, formatted string"
    return formatted.mapInArrow(_read, kind)
