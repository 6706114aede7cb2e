"""Chat formatting: a small sandboxed template language, compiled to Python closures."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns are marked by these strings. None of them can stand inside an escaped text, as
#: each begins with a character that escaping puts a backslash before.
TEMPLATE = """
{%- for m in messages -%}
{%- if m.role == 'user' -%}{{ '<s>' + '[INST] ' }}{{ m.text | escape }}{{ ' [/INST]' }}
{%- elif m.role == 'assistant' -%}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
{%- else -%}{{ '<<' }}{{ m.role | escape }}{{ '>>' }}{{ m.text | escape }}{{ '<</>>' }}
{%- endif -%}
{%- endfor -%}
"""


def escape(text: str) -> str:
    """A backslash before every character that a control string can begin with."""
    return re.sub(r"[\\<>\[]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}

# ---- syntax tree: tuples, first the kind -------------------------------------------------

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|.+()]))")


class TemplateError(ValueError):
    pass


class _Expression:
    """or < and < not < comparison < + < filter < member < atom. Members are looked up in
    mappings only and calls do not exist, so a template reaches nothing but its data."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(m.groups())
            at = m.end()
        self.at = 0

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at]}")
        return node

    def take(self, *texts: str) -> str | None:
        """The next name or sign, if it is one of these."""
        if self.at < len(self.tokens):
            _, _, name, sign = self.tokens[self.at]
            if (name or sign) in texts:
                self.at += 1
                return name or sign
        return None

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        sign = self.take("==", "!=")
        return (sign, node, self.added()) if sign else node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.take("|"):
            name = self.tokens[self.at][2] if self.at < len(self.tokens) else None
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = ("filter", name, node)
        return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
        elif self.at < len(self.tokens):
            text, number, name, sign = self.tokens[self.at]
            self.at += 1
            if text is not None:
                node = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
            elif number is not None:
                node = ("const", int(number))
            elif name is not None:
                node = ("const", {"true": True, "false": False}[name]) if name in ("true", "false") else ("name", name)
            else:
                raise TemplateError(f"unexpected {sign!r}")
        else:
            raise TemplateError("expression ends early")
        while self.take("."):
            name = self.tokens[self.at][2] if self.at < len(self.tokens) else None
            if name is None:
                raise TemplateError("missing member name")
            self.at += 1
            node = ("member", node, name)
        return node


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces, at, trim = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        left, right = (m[1], m[3]) if m[2] is not None else (m[4], m[6])
        text = text.lstrip() if trim else text
        pieces.append(("text", text.rstrip() if left else text))
        pieces.append(("print", m[2]) if m[2] is not None else ("tag", m[5].strip()))
        at, trim = m.end(), bool(right)
    tail = source[at:]
    pieces.append(("text", tail.lstrip() if trim else tail))
    pieces.reverse()

    def block(*ends: str) -> tuple[list[tuple], str]:
        nodes: list[tuple] = []
        while pieces:
            kind, value = pieces.pop()
            if kind == "text":
                nodes.append(("print", ("const", value)))
            elif kind == "print":
                nodes.append(("print", _Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return nodes, value
                nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return nodes, ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest)
            if not m:
                raise TemplateError(f"cannot read for {rest!r}")
            return ("for", m[1], _Expression(m[2]).whole(), block("endfor")[0])
        if word == "if":
            body, end = block("elif", "else", "endif")
            if end.startswith("elif"):
                return ("if", _Expression(rest).whole(), body, [statement("if", end[4:])])
            return ("if", _Expression(rest).whole(), body, block("endif")[0] if end == "else" else [])
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    return ("block", block()[0])


# ---- constant folding ---------------------------------------------------------------------

_BINARY = {
    "+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def fold(node: tuple) -> tuple:
    """The tree with every constant part computed, dead branches gone and neighbouring
    constant output in one piece."""
    kind = node[0]
    if kind in _BINARY:
        left, right = fold(node[1]), fold(node[2])
        if left[0] == right[0] == "const":
            return ("const", _BINARY[kind](left[1], right[1]))
        return (kind, left, right)
    if kind == "not":
        inner = fold(node[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "filter":
        inner = fold(node[2])
        return ("const", FILTERS[node[1]](str(inner[1]))) if inner[0] == "const" else ("filter", node[1], inner)
    if kind == "member":
        return ("member", fold(node[1]), node[2])
    if kind == "print":
        return ("print", fold(node[1]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), _fold_all(node[3]))
    if kind == "generation":
        return ("generation", _fold_all(node[1]))
    if kind == "block":
        return ("block", _fold_all(node[1]))
    if kind == "if":
        test = fold(node[1])
        if test[0] == "const":
            return ("block", _fold_all(node[2] if test[1] else node[3]))
        return ("if", test, _fold_all(node[2]), _fold_all(node[3]))
    return node


def _fold_all(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    waiting = [fold(n) for n in reversed(nodes)]
    while waiting:
        node = waiting.pop()
        if node[0] == "block":
            waiting += reversed(node[1])
        elif node[0] == "print" and node[1][0] == "const":
            text = str(node[1][1])
            if out and out[-1][0] == "print" and out[-1][1][0] == "const":
                out[-1] = ("print", ("const", out[-1][1][1] + text))
            elif text:
                out.append(("print", ("const", text)))
        else:
            out.append(node)
    return out


# ---- closures -----------------------------------------------------------------------------


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda scope, value=node[1]: value
    if kind == "name":
        return lambda scope, name=node[1]: scope.get(name, "")
    if kind == "member":
        inner, name = _value(node[1]), node[2]

        def member(scope: dict) -> object:
            owner = inner(scope)
            return owner.get(name, "") if type(owner) is dict else ""

        return member
    if kind == "filter":
        inner, change = _value(node[2]), FILTERS[node[1]]
        return lambda scope: change(str(inner(scope)))
    if kind == "not":
        inner = _value(node[1])
        return lambda scope: not inner(scope)
    left, right = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    join = _BINARY[kind]
    return lambda scope: join(left(scope), right(scope))


Pieces = Iterator[tuple[str, bool]]


def _emitter(node: tuple) -> Callable[[dict, bool], Pieces]:
    """A closure that yields (text, is it under the generation mark)."""
    kind = node[0]
    if kind == "print":
        value = _value(node[1])

        def emit(scope: dict, marked: bool) -> Pieces:
            yield str(value(scope)), marked

    elif kind == "block":
        parts = [_emitter(n) for n in node[1]]

        def emit(scope: dict, marked: bool) -> Pieces:
            for part in parts:
                yield from part(scope, marked)

    elif kind == "generation":
        inner = _emitter(("block", node[1]))

        def emit(scope: dict, marked: bool) -> Pieces:
            yield from inner(scope, True)

    elif kind == "if":
        test, then, other = _value(node[1]), _emitter(("block", node[2])), _emitter(("block", node[3]))

        def emit(scope: dict, marked: bool) -> Pieces:
            yield from (then if test(scope) else other)(scope, marked)

    else:
        name, items, body = node[1], _value(node[2]), _emitter(("block", node[3]))

        def emit(scope: dict, marked: bool) -> Pieces:
            for number, item in enumerate(items(scope) or ()):
                yield from body({**scope, name: item, "loop": {"index0": number, "first": not number}}, marked)

    return emit


def compile_template(source: str) -> Callable[[dict], Pieces]:
    """A function from the template's data to its output, piece by piece. ``messages`` may be
    any iterable: a conversation streams through, however long."""
    emit = _emitter(fold(parse(source)))
    return lambda scope: emit(scope, False)


# ---- reading back -------------------------------------------------------------------------

_ESCAPED = r"(?:[^\\<>\[]|\\.)*+"
_TURN = re.compile(
    rf"<<(?P<role>{_ESCAPED})>>(?P<text>{_ESCAPED})<</>>|(?P<answer>{_ESCAPED})</s>", re.DOTALL,
)
# Escaped text may end in the space that closes a user turn.
_USER = re.compile(rf"<s>\[INST\] (?P<user>{_ESCAPED})\[/INST\]", re.DOTALL)


class Reader:
    """Reads turns back from formatted output as it arrives."""

    def __init__(self):
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """The turns (role, text) that are complete by now."""
        self.rest += text
        at = 0
        while True:
            if self.rest.startswith("<s>", at):
                m = _USER.match(self.rest, at)
                turn = m and ("user", m["user"][:-1])
            else:
                m = _TURN.match(self.rest, at)
                turn = m and (("assistant", m["answer"]) if m["answer"] is not None else (unescape(m["role"]), m["text"]))
            if not m:
                break
            yield turn[0], unescape(turn[1])
            at = m.end()
        self.rest = self.rest[at:]


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Sorted rows (conv_id, turn, role, text) as one stream of turns per conversation."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in (b.column(0), b.column(2), b.column(3)))))
    for conv_id, turns in groupby(rows, key=lambda r: r[0]):
        yield conv_id, ({"role": role or "", "text": text or ""} for _, role, text in turns)


def _by_turn(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def render(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id``, ``formatted`` and ``generated`` (start and end in code points of each piece
    under the generation mark) per conversation.

    Rows (conv_id, turn, role, text) are put in order of turn, ties by role and text, nulls
    first. Null text and role are empty; rows with a null conv_id are one conversation;
    repeated rows are turns of their own. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = compile_template(template)
        for conv_id, turns in _conversations(batches):
            pieces, spans, at = [], [], 0
            for text, marked in write({"messages": turns}):
                if marked:
                    spans.append({"start": at, "end": at + len(text)})
                at += len(text)
                pieces.append(text)
            yield pa.RecordBatch.from_arrays([
                pa.array([conv_id], pa.int64()), pa.array(["".join(pieces)]),
                pa.array([spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ], ["conv_id", "formatted", "generated"])

    return _by_turn(conversations).mapInArrow(run, "conv_id long, formatted string, generated array<struct<start:int,end:int>>")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """What is read back from the formatted output, as counts and digests. Streams turn by
    turn: a conversation of any length needs the memory of its largest turn. Rows as in
    ``render``. Sorting by (conv_id, turn) spills to disk where it must."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, out = compile_template(template), []
        for conv_id, turns in _conversations(batches):
            reader, of_turns, of_loss = Reader(), hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = formatted_chars = 0
            for text, marked in write({"messages": turns}):
                formatted_chars += len(text)
                if marked:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    of_loss.update(plain.encode("utf-8", "surrogatepass"))
                for role, content in reader.feed(text):
                    n_turns += 1
                    of_turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
            if reader.rest:
                raise ValueError(f"conversation {conv_id}: output cannot be read back from {reader.rest[:40]!r}")
            out.append((conv_id, n_turns, of_turns.hexdigest(), loss_chars, of_loss.hexdigest(), formatted_chars))
            if len(out) == 4096:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return _by_turn(conversations).mapInArrow(run, DIGEST)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def with_probe(conversations: DataFrame, conv_id: int = -7, text: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """The conversations plus one whose texts look like the template's own marks."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = conversations.sparkSession.createDataFrame(
        [(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(probe)
