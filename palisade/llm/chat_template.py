"""Operator 7: chat formatting by a compiled, sandboxed template language.

Source -> tokens -> syntax tree -> folded tree -> Python closures.  The
language has text, ``{{ expression }}``, ``{% for x in messages %}``,
``{% if %}/{% elif %}/{% else %}/{% endif %}``, ``{% set x = expression %}``
and ``{% generation %}/{% endgeneration %}`` around what the loss covers.
Expressions have strings, integers, names, ``.field`` of a message or of
``loop``, ``== != ~ and or not``, parentheses and filters.  There are no calls,
no indexing and no Python attributes, so a template reaches nothing but the
messages.  Closures write to a sink piece by piece and pull messages one by
one: memory is that of one turn, however long the conversation.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palisade.llm.shared import small_batches, table, text_or_empty

#: A turn is "### Role: text</turn>\n"; inside roles and texts the characters
#: that could start a control string carry a backslash, as backslashes do.
DEFAULT = (
    "{% for m in messages %}"
    "### {{ m.role | escape }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)
_ESCAPED = re.compile(r"[\\#<:]")
_TURN = re.compile(r"### ([^\\#<:]*(?:\\.[^\\#<:]*)*): ([^\\#<:]*(?:\\.[^\\#<:]*)*)</turn>\n", re.S)


def escape(s: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


FILTERS = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template is outside the language."""


# --- syntax tree -----------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Name
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass
class Text:
    text: str


@dataclass
class Print:
    value: object


@dataclass
class For:
    name: str
    over: str
    body: list = field(default_factory=list)


@dataclass
class If:
    arms: list = field(default_factory=list)  # (condition, body)


@dataclass
class Set:
    name: str
    value: object


@dataclass
class Generation:
    body: list = field(default_factory=list)


_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_LEX = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[~|.()]))")


class _Expression:
    """Recursive descent: or < and < not < comparison < ~ < filter < field."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"bad expression: {source[at:]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def parse(self):
        out = self.any()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != 1 and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def any(self):
        out = self.all()
        while self.take("or"):
            out = Op("or", (out, self.all()))
        return out

    def all(self):
        out = self.negation()
        while self.take("and"):
            out = Op("and", (out, self.negation()))
        return out

    def negation(self):
        return Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        out = self.concatenation()
        op = self.take("==", "!=")
        return Op(op, (out, self.concatenation())) if op else out

    def concatenation(self):
        out = self.filtered()
        while self.take("~"):
            out = Op("~", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.primary()
        while self.take("|"):
            out = Filter(self.name(), out)
            if out.name not in FILTERS:
                raise TemplateError(f"no filter {out.name}")
        return out

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != 3:
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def primary(self):
        if self.take("("):
            out = self.any()
            if not self.take(")"):
                raise TemplateError("')' is missing")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, text = self.tokens[self.at]
        if kind == 4:
            raise TemplateError(f"unexpected {text!r}")
        self.at += 1
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == 2:
            return Const(int(text))
        if text in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[text])
        out = Name(text)
        if self.take("."):
            out = Field(out, self.name())
            if out.name.startswith("_") or self.take("."):
                raise TemplateError("only plain fields can be read")
        return out


def parse(source: str) -> list:
    """Syntax tree of a template."""
    root: list = []
    stack: list[tuple[str, object, list]] = [("", None, root)]
    for part in _TAG.split(source):
        body = stack[-1][2]
        if part.startswith("{{"):
            body.append(Print(_Expression(part[2:-2]).parse()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*)", rest.strip())
                if not m:
                    raise TemplateError(f"bad for: {rest!r}")
                body.append(node := For(m[1], m[2]))
                stack.append(("for", node, node.body))
            elif word == "if":
                body.append(node := If([(_Expression(rest).parse(), [])]))
                stack.append(("if", node, node.arms[-1][1]))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                node = stack.pop()[1]
                node.arms.append((_Expression(rest).parse() if word == "elif" else Const(True), []))
                stack.append(("if", node, node.arms[-1][1]))
            elif word == "generation":
                body.append(node := Generation())
                stack.append(("generation", node, node.body))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z]\w*)\s*=(.*)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"bad set: {rest!r}")
                body.append(Set(m[1], _Expression(m[2]).parse()))
            elif word.startswith("end") and stack[-1][0] == word[3:] != "":
                stack.pop()
            else:
                raise TemplateError(f"unexpected tag {word!r}")
        elif part:
            body.append(Text(part))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return root


def fold(node):
    """The tree with constant parts computed and neighbouring texts joined."""
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if all(isinstance(a, Const) for a in args):
            return Const(_OPS[node.op](*(lambda v=a.value: v for a in args)))
        return Op(node.op, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](_text(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, list):
        out: list = []
        for x in map(fold, node):
            if isinstance(x, Print) and isinstance(x.value, Const):
                x = Text(_text(x.value.value))
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif not isinstance(y, Text) or y.text:
                    out.append(y)
        return out
    if isinstance(node, Print):
        return Print(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, node.over, fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for condition, body in node.arms:
            condition, body = fold(condition), fold(body)
            if not (isinstance(condition, Const) and not condition.value):
                arms.append((condition, body))
            if isinstance(condition, Const) and condition.value:
                break
        if not arms:
            return []
        return arms[0][1] if isinstance(arms[0][0], Const) else If(arms)
    return node


def _text(value) -> str:
    return "" if value is None else str(value)


_OPS = {
    "==": lambda a, b: a() == b(),
    "!=": lambda a, b: a() != b(),
    "~": lambda a, b: _text(a()) + _text(b()),
    "and": lambda a, b: a() and b(),
    "or": lambda a, b: a() or b(),
    "not": lambda a: not a(),
}


# --- closures --------------------------------------------------------------


def _expression(node, scope: frozenset):
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        if node.name not in scope:
            raise TemplateError(f"unknown name {node.name}")
        return lambda env, k=node.name: env[k]
    if isinstance(node, Field):
        of = _expression(node.of, scope)
        return lambda env, k=node.name: of(env).get(k)
    if isinstance(node, Filter):
        of, f = _expression(node.of, scope), FILTERS[node.name]
        return lambda env: f(_text(of(env)))
    args, op = [_expression(a, scope) for a in node.args], _OPS[node.op]
    if len(args) == 1:
        return lambda env: op(lambda: args[0](env))
    return lambda env: op(lambda: args[0](env), lambda: args[1](env))


def _block(nodes: list, scope: frozenset):
    steps = []
    for node in nodes:
        steps.append(_statement(node, scope))
        if isinstance(node, Set):
            scope = scope | {node.name}

    def run(env, emit, mask):
        for step in steps:
            step(env, emit, mask)

    return run


def _statement(node, scope: frozenset):
    if isinstance(node, Text):
        return lambda env, emit, mask, t=node.text: emit(t, mask)
    if isinstance(node, Print):
        value = _expression(node.value, scope)
        return lambda env, emit, mask: emit(_text(value(env)), mask)
    if isinstance(node, Set):
        value = _expression(node.value, scope)

        def assign(env, emit, mask, k=node.name):
            env[k] = value(env)

        return assign
    if isinstance(node, Generation):
        body = _block(node.body, scope)
        return lambda env, emit, mask: body(env, emit, True)
    if isinstance(node, If):
        arms = [(_expression(c, scope), _block(b, scope)) for c, b in node.arms]

        def choose(env, emit, mask):
            for condition, body in arms:
                if condition(env):
                    return body(env, emit, mask)

        return choose
    if node.over not in scope:
        raise TemplateError(f"unknown name {node.over}")
    body = _block(node.body, scope | {node.name, "loop"})

    def loop(env, emit, mask, name=node.name, over=node.over):
        items = iter(env[over])
        item = next(items, None)
        index = 0
        while item is not None:
            following = next(items, None)  # one ahead, for loop.last
            index += 1
            body(env | {name: item, "loop": {"index": index, "first": index == 1, "last": following is None}}, emit, mask)
            item = following

    return loop


@lru_cache(16)
def compile_template(source: str):
    """render(messages, emit): emit(piece, masked) gets the output in order."""
    body = _block(fold(parse(source)), frozenset({"messages"}))
    return lambda messages, emit: body({"messages": messages}, emit, False)


def render(source: str, messages) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the code-point spans that the loss covers."""
    pieces: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0

    def emit(piece: str, masked: bool) -> None:
        nonlocal at
        if masked and piece:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(piece))
            else:
                spans.append((at, at + len(piece)))
        pieces.append(piece)
        at += len(piece)

    compile_template(source)(messages, emit)
    return "".join(pieces), spans


class Reader:
    """Sink that reads turns back from the formatted characters and their mask, keeping one turn at a time."""

    def __init__(self):
        self.buffer: list[str] = []
        self.mask: list[str] = []
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def __call__(self, piece: str, masked: bool) -> None:
        self.chars += len(piece)
        self.buffer.append(piece)
        if masked:
            self.mask.append(piece)
        if "</turn>\n" in piece:
            self.drain()

    def drain(self) -> None:
        text, at = "".join(self.buffer), 0
        while m := _TURN.match(text, at):
            at = m.end()
            self.turns += 1
            for part in m.groups():
                self.all.update(unescape(part).encode("utf-8", "surrogatepass") + b"\n")
        self.buffer = [text[at:]]
        if not self.buffer[0]:
            covered = unescape("".join(self.mask))
            self.loss_chars += len(covered)
            self.loss.update(covered.encode("utf-8", "surrogatepass"))
            self.mask = []

    def result(self):
        if "".join(self.buffer):
            raise ValueError("the formatted text does not read back as turns")
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _in_order(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns of a conversation together and in order; equal turn numbers go by role, then text; null turns first."""
    chosen = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text"))
    return chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(df: DataFrame, template: str = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans array<struct<start:long,end:long>> in code points.

    Null roles and texts count as empty, rows with a null conversation id form
    one conversation, repeated rows are turns of their own, and an empty table
    gives an empty one.
    """

    def run(batches):
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            text, spans = render(template, ({"role": r, "text": t} for _, r, t in rows))
            yield pa.record_batch([pa.array([conv], kind), pa.array([text]), pa.array([[{"start": a, "end": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv_id", "formatted", "loss_spans"])

    compile_template(template)  # errors show here, not in a task
    small_batches(df.sparkSession)
    kind = to_arrow_type(df.schema[conv_col].dataType)
    return _in_order(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, f"conv_id {df.schema[conv_col].dataType.simpleString()}, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Format by DEFAULT and read the output back: turn and loss digests of each conversation.

    A conversation streams through one task turn by turn, so that its length
    does not bound memory; digests in order can't be had in parallel.
    """

    def run(batches):
        out: list[tuple] = []
        write = compile_template(DEFAULT)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            sink = Reader()
            write(({"role": r, "text": t} for _, r, t in rows), sink)
            out.append((conv, *sink.result()))
            if len(out) == 2000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    small_batches(df.sparkSession)
    kind = to_arrow_type(df.schema[conv_col].dataType)
    return _in_order(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, f"conv_id {df.schema[conv_col].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all conversations and one, -7, whose texts hold the control strings themselves."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(rows.unionByName(extra))


def oracle_sql() -> str:
    """DuckDB: every digest but formatted_chars follows from the input alone; that one counts characters and escapes."""
    return r"""
    WITH rows AS (
      SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      sum(14 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g')))::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id
    """
