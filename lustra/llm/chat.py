"""Chat formatting: a small sandboxed template language, compiled to Python closures.

``{{ expr }}`` prints, ``{% if %} {% elif %} {% else %} {% endif %}`` and
``{% for x in xs %} {% endfor %}`` control, ``{% set x = expr %}`` names a value and
``{% generation %} {% endgeneration %}`` marks what the model writes.  Expressions have literals,
names, item access (``a.b``, ``a['b']``, ``a[0]``), ``+ - * ~ == != < > <= >= in not and or``, and
filters.  There are no calls, no attributes of objects and no imports: ``a.b`` looks up a key of a
mapping and nothing else.  Source is parsed into a syntax tree, constant parts are folded, and the
rest becomes nested closures.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """The template is not in the language."""


def escape(text: str) -> str:
    """Reversibly break up control strings: no ``<|`` and no raw newline-free marker survives."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_name(text: str) -> str:
    """For a role, which ends at a newline."""
    return escape(text).replace("\n", "\\n")


def unescape_name(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(str(x)),
    "escape_name": lambda x: escape_name(str(x)),
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "string": str,
}
#: Most characters that an expression may add to a string, or build by repeating one.  Texts themselves may be
#: of any length; a template from elsewhere can't make them grow by doubling.
LONGEST = 1 << 20


def _times(a: Any, b: Any) -> Any:
    n, text = (b, a) if isinstance(a, (str, list)) else (a, b)
    if isinstance(text, (str, list)) and isinstance(n, int) and n * len(text) > LONGEST:
        raise TemplateError(f"a value of over {LONGEST} characters")
    if isinstance(a, int) and isinstance(b, int) and a.bit_length() + b.bit_length() > 4096:
        raise TemplateError("too large a number")
    return a * b


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, (str, list)) and isinstance(b, (str, list)) and min(len(a), len(b)) > LONGEST:
        raise TemplateError(f"two values of over {LONGEST} characters put together")
    return a + b


def _join(a: Any, b: Any) -> str:
    """Both as text; what isn't there is empty, as where it is printed."""
    return _plus(*("" if x is None else str(x) for x in (a, b)))


_BINARY = {
    "+": _plus, "-": operator.sub, "*": _times, "~": _join, "==": operator.eq, "!=": operator.ne,
    "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b,
}
_LEVELS = [["or"], ["and"], ["==", "!=", "<", ">", "<=", ">=", "in"], ["+", "-", "~"], ["*"]]
_TOKEN = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z]\w*)|(==|!=|<=|>=|[-+*~<>.\[\]()|]))""")
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t"}


class _Parser:
    """Expressions to tuples: ("const", v), ("name", n), ("item", a, b), ("filter", f, a),
    ("not", a), ("op", o, a, b)."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, Any]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            at = m.end()
            if m[1]:
                self.tokens.append(("const", int(m[1])))
            elif m[2]:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m[2][1:-1])))
            elif m[3] and m[3] in _WORDS:
                self.tokens.append(("const", _WORDS[m[3]]))
            elif m[3] and m[3] not in ("and", "or", "not", "in"):
                self.tokens.append(("name", m[3]))
            else:
                self.tokens.append(("sign", m[3] or m[4]))
        self.at = 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, sign: str | None = None) -> tuple[str, Any]:
        token = self.peek()
        if sign is not None and token != ("sign", sign):
            raise TemplateError(f"expected {sign!r}, found {token[1]!r}")
        self.at += 1
        return token

    def whole(self) -> tuple:
        tree = self.binary(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def binary(self, level: int) -> tuple:
        if level == len(_LEVELS):
            return self.unary()
        tree = self.binary(level + 1)
        while self.peek()[0] == "sign" and self.peek()[1] in _LEVELS[level]:
            sign = self.take()[1]
            tree = ("op", sign, tree, self.binary(level + 1))
        return tree

    def unary(self) -> tuple:
        if self.peek() == ("sign", "not"):
            self.take()
            return ("not", self.unary())
        kind, value = self.take()
        if kind == "const":
            tree: tuple = ("const", value)
        elif kind == "name":
            tree = ("name", value)
        elif (kind, value) == ("sign", "("):
            tree = self.binary(0)
            self.take(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek()[0] == "sign" and self.peek()[1] in (".", "[", "|"):
            sign = self.take()[1]
            if sign == "[":
                tree = ("item", tree, self.binary(0))
                self.take("]")
                continue
            kind, value = self.take()
            if kind != "name":
                raise TemplateError(f"expected a name, found {value!r}")
            if sign == ".":
                tree = ("item", tree, ("const", value))
            elif value not in FILTERS:
                raise TemplateError(f"no filter {value!r}")
            else:
                tree = ("filter", value, tree)
        return tree


def _fold(tree: tuple) -> tuple:
    """Replace every part without names by its value."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    tree = (kind, *(_fold(x) if isinstance(x, tuple) else x for x in tree[1:]))
    parts = [x for x in tree[1:] if isinstance(x, tuple)]
    if all(x[0] == "const" for x in parts):
        try:
            return ("const", _expression(tree)({}))
        except TemplateError:
            raise
        except Exception as e:
            raise TemplateError(f"constant expression fails: {e}") from e
    return tree


def _item(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, str)) and isinstance(key, int):
        return value[key]
    raise TemplateError(f"no item {key!r}")


def _expression(tree: tuple) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "item":
        a, b = _expression(tree[1]), _expression(tree[2])
        return lambda scope: _item(a(scope), b(scope))
    if kind == "filter":
        f, a = FILTERS[tree[1]], _expression(tree[2])
        return lambda scope: f(a(scope))
    if kind == "not":
        a = _expression(tree[1])
        return lambda scope: not a(scope)
    sign, a, b = tree[1], _expression(tree[2]), _expression(tree[3])
    if sign == "and":
        return lambda scope: a(scope) and b(scope)
    if sign == "or":
        return lambda scope: a(scope) or b(scope)
    f = _BINARY[sign]
    return lambda scope: f(a(scope), b(scope))


class _Out:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.marks: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def parse(source: str) -> list[tuple]:
    """The syntax tree.  A tag that isn't closed is an error.  What ``set`` puts down in a loop holds for the
    rounds that follow, and ends with the loop.  Nodes: ("text", s), ("print", e), ("if", [(e, body)...], body), ("for", name, e,
    body), ("set", name, e), ("generation", body)."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    for t in parts[::2]:
        if "{{" in t or "{%" in t:
            raise TemplateError(f"unclosed tag in {t[:80]!r}")
    tokens = [t for t in parts if t]
    at = 0

    def body(stops: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(tokens):
            t = tokens[at]
            at += 1
            if t.startswith("{{"):
                tree = _fold(_Parser(t[2:-2]).whole())
                nodes.append(("text", "" if tree[1] is None else str(tree[1])) if tree[0] == "const" else ("print", tree))
            elif t.startswith("{%"):
                inner = t[2:-2].strip().strip("-").strip()
                word, _, rest = inner.partition(" ")
                if word in stops:
                    return nodes, inner
                if word == "if":
                    branches, test = [], rest
                    other: list[tuple] = []
                    while True:
                        part, stop = body(("elif", "else", "endif"))
                        branches.append((_fold(_Parser(test).whole()), part))
                        if stop.startswith("elif"):
                            test = stop[4:]
                            continue
                        if stop == "else":
                            other, stop = body(("endif",))
                        break
                    nodes += _fold_if(branches, other)
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad loop {inner!r}")
                    nodes.append(("for", m[1], _fold(_Parser(m[2]).whole()), body(("endfor",))[0]))
                elif word == "set":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad assignment {inner!r}")
                    nodes.append(("set", m[1], _fold(_Parser(m[2]).whole())))
                elif word == "generation":
                    nodes.append(("generation", body(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"unknown statement {inner!r}")
            else:
                nodes.append(("text", t))
        if stops:
            raise TemplateError(f"missing {' or '.join(stops)}")
        return _joined(nodes), ""

    nodes, _ = body(())
    return nodes


def _fold_if(branches: list[tuple], other: list[tuple]) -> list[tuple]:
    """Drop branches that can't run."""
    live = []
    for test, part in branches:
        if test[0] == "const":
            if test[1]:
                other = part
                break
            continue
        live.append((test, part))
    return [("if", live, other)] if live else other


def _joined(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for n in nodes:
        if n[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + n[1])
        else:
            out.append(n)
    return out


def _emit(nodes: list[tuple]) -> Callable[[dict, _Out], None]:
    steps = [_step(n) for n in _joined(nodes)]

    def run(scope: dict, out: _Out) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node: tuple) -> Callable[[dict, _Out], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda scope, out: out.put(text)
    if kind == "print":
        value = _expression(node[1])

        def show(scope: dict, out: _Out) -> None:
            v = value(scope)
            out.put("" if v is None else str(v))

        return show
    if kind == "set":
        name, value = node[1], _expression(node[2])

        def put(scope: dict, out: _Out) -> None:
            scope[name] = value(scope)

        return put
    if kind == "if":
        branches = [(_expression(t), _emit(b)) for t, b in node[1]]
        other = _emit(node[2])

        def choose(scope: dict, out: _Out) -> None:
            for test, part in branches:
                if test(scope):
                    return part(scope, out)
            return other(scope, out)

        return choose
    if kind == "for":
        name, values, part = node[1], _expression(node[2]), _emit(node[3])

        def loop(scope: dict, out: _Out) -> None:
            inner = dict(scope)
            for v in values(scope) or ():
                inner[name] = v
                part(inner, out)

        return loop
    part = _emit(node[1])

    def mark(scope: dict, out: _Out) -> None:
        start = out.size
        part(scope, out)
        out.marks.append((start, out.size))

    return mark


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to the rendered text and the spans inside generation markers."""
    run = _emit(parse(source))

    def render(scope: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(dict(scope), out)
        return "".join(out.parts), out.marks

    return render


TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' ~ m.role|escape_name ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)
_START, _END = "<|im_start|>", "<|im_end|>\n"


def read_back(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a conversation rendered with :data:`TEMPLATE`."""
    turns, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(_END, line)
        if not text.startswith(_START, at):
            raise ValueError("not a turn")
        turns.append((unescape_name(text[at + len(_START) : line]), unescape(text[line + 1 : end])))
        at = end + len(_END)
    return turns


_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted", "loss_spans"]


def format_conversations(rows: DataFrame, template: str = TEMPLATE, with_text: bool = True, reader: Callable[[str], list[tuple[str, str]]] | None = None) -> DataFrame:
    """Format each conv_id's rows (turn, role, text) in order of turn, and read the result back.

    Returns conv_id, n_turns, turns_sha256 (of role, newline, text, newline for each turn read
    back), loss_chars and loss_sha256 (of the unescaped text inside generation markers),
    formatted_chars, formatted, loss_spans (code point offsets).

    ``reader`` is the inverse of another template than the built-in one; without it turns_sha256 is
    null there, n_turns is the number of rows, and the loss text is taken as rendered.

    Defined cases: null texts and roles are empty; null turns come first; equal turns are ordered
    by role, then text, and repeated rows are turns of their own; rows without conv_id form one
    conversation; an empty table stays empty; other columns are ignored.  Each conversation is
    rendered on its own, so memory is bounded by the longest one.
    """
    compile_template(template)
    reader = read_back if template == TEMPLATE and reader is None else reader

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        out: list[tuple] = []
        held = 0
        key: Any = run
        messages: list[dict] = []

        def finish() -> None:
            nonlocal held
            text, marks = render({"messages": messages})
            turns = reader(text) if reader else None
            loss = "".join(unescape(text[a:b]) if reader else text[a:b] for a, b in marks)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "replace")).hexdigest() if reader else None
            out.append((key, len(turns) if reader else len(messages), digest, len(loss), hashlib.sha256(loss.encode("utf-8", "replace")).hexdigest(), len(text), text if with_text else None, [{"start": a, "end": b} for a, b in marks]))
            held += len(text) if with_text else 300

        def flush() -> pa.RecordBatch:
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), spans]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=_COLUMNS)

        for batch in batches:
            for conv, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if conv != key:
                    if key is not run:
                        finish()
                        if held > 4 << 20:
                            yield flush()
                            out, held = [], 0
                    key, messages = conv, []
                messages.append({"role": role or "", "text": text or ""})
        if key is not run:
            finish()
        if out:
            yield flush()

    picked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = picked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string, loss_spans array<struct<start:long,end:long>>"
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)
