"""Chat formatting by a template compiler.

A small sandboxed template language (text, ``{{ expr }}``, ``for``, ``if/elif/else``, ``set``, ``generation``) is
parsed into a syntax tree of tuples, constants are folded, and the tree becomes Python closures that write
to a buffer and mark the spans under ``generation``. Names reach only the values passed in, ``.key`` reads only
mappings and lists, filters come from a fixed list and nothing can be called: a template cannot reach the interpreter.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows keep a fixed order and repeated rows stay turns of their own; rows with a null conversation id form one
conversation; an empty table gives no rows; columns other than the four named are ignored.
A conversation is one output row, so its turns meet in one task, as its formatted text does in any layout.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- the language -------------------------------------------------------------------------------
_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_LEX = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)"
                  r"|(?P<op>==|!=|<=|>=|[-+*~|.,()\[\]<>]))", re.S)


class TemplateError(ValueError):
    """The template is not well formed, or asks for something outside the sandbox."""


def escape_control(text: str) -> str:
    """A backslash inside each control string; more backslashes where some are there already, so it can be undone."""
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape_control(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][:-1] + m[3], text)


# control strings [INST] [/INST] [TURN] [/TURN] <s> </s>, with any backslashes between bracket and name
_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]|TURN\]))")

FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape_control(_text(v)),
    "line": lambda v: _text(v).replace("\\", "\\\\").replace("\n", "\\n"),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if v is not None else 0,
    "json": lambda v: json.dumps(v, ensure_ascii=False),
    "default": lambda v, d="": d if v is None else v,
}
_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "~": lambda a, b: _text(a) + _text(b),
}
_LEVELS = (("==", "!=", "<", ">", "<=", ">=", "in"), ("~",), ("+", "-"), ("*",))


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


class _Expressions:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.items, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] in ("op", "name") and self.items[self.at][1] in values

    def take(self, *values):
        if self.peek(*values):
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, value):
        if self.take(value) is None:
            raise TemplateError(f"expected {value!r}")

    def whole(self):
        tree = self.choice()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return tree

    def choice(self):
        value = self.logic("or")
        if self.take("if"):
            cond = self.logic("or")
            return ("choose", cond, value, self.choice() if self.take("else") else ("lit", None))
        return value

    def logic(self, word):
        inner = (lambda: self.logic("and")) if word == "or" else self.negation
        tree = inner()
        while self.take(word):
            tree = (word, tree, inner())
        return tree

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.binary(0)

    def binary(self, level):
        if level == len(_LEVELS):
            return self.filtered()
        tree = self.binary(level + 1)
        while op := self.take(*_LEVELS[level]):
            tree = ("bin", op, tree, self.binary(level + 1))
        return tree

    def filtered(self):
        tree = self.postfix()
        while self.take("|"):
            kind, name = self.items[self.at] if self.at < len(self.items) else ("", "")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            args = []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.choice())
                    self.take(",")
            tree = ("filter", name, tree, *args)
        return tree

    def postfix(self):
        tree = self.atom()
        while True:
            if self.take("."):
                kind, name = self.items[self.at] if self.at < len(self.items) else ("", "")
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"no key {name!r}")
                self.at += 1
                tree = ("get", tree, ("lit", name))
            elif self.take("["):
                tree = ("get", tree, self.choice())
                self.need("]")
            else:
                return tree

    def atom(self):
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        if self.at >= len(self.items):
            raise TemplateError("expression ends early")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "num":
            return ("lit", int(value))
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return ("lit", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """Syntax tree of a template: a list of statements."""
    pieces = _TAGS.split(source)
    at = 0

    def block(*ends):
        nonlocal at
        body = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{#") or not piece:
                continue
            if piece.startswith("{{"):
                body.append(("out", _Expressions(piece[2:-2]).whole()))
            elif piece.startswith("{%"):
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return body, word, rest
                body.append(statement(word, rest))
            else:
                body.append(("text", piece))
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return body, "", ""

    def statement(word, rest):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read for {rest!r}")
            return ("for", m[1], _Expressions(m[2]).whole(), block("endfor")[0])
        if word == "if":
            branches, other, cond = [], [], _Expressions(rest).whole()
            while True:
                body, end, rest = block("elif", "else", "endif")
                branches.append((cond, body))
                if end == "elif":
                    cond = _Expressions(rest).whole()
                    continue
                if end == "else":
                    other = block("endif")[0]
                return ("if", branches, other)
        if word == "set":
            name, _, value = rest.partition("=")
            return ("set", name.strip(), _Expressions(value).whole())
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    return block()[0]


# -- folding ------------------------------------------------------------------------------------
def fold(tree):
    """The expression with every constant part worked out."""
    kind = tree[0]
    if kind in ("lit", "name"):
        return tree
    head = 2 if kind in ("bin", "filter") else 1
    tree = (*tree[:head], *map(fold, tree[head:]))
    if kind in ("and", "or") and tree[1][0] == "lit":
        return tree[2] if bool(tree[1][1]) == (kind == "and") else tree[1]
    if kind == "choose" and tree[1][0] == "lit":
        return tree[2] if tree[1][1] else tree[3]
    if all(x[0] == "lit" for x in tree[head:]):
        return ("lit", closure(tree)({}))
    return tree


def fold_block(body: list) -> list:
    """Constant output becomes text, decided branches go, neighbouring texts join."""
    out = []

    def add(node):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "out":
            value = fold(node[1])
            add(("text", _text(value[1])) if value[0] == "lit" else ("out", value))
        elif node[0] == "if":
            branches, other = [], fold_block(node[2])
            for cond, inner in node[1]:
                cond = fold(cond)
                if cond[0] == "lit" and not cond[1]:
                    continue
                if cond[0] == "lit":
                    other = fold_block(inner)
                    break
                branches.append((cond, fold_block(inner)))
            if branches:
                add(("if", branches, other))
            else:
                for x in other:
                    add(x)
        elif node[0] == "for":
            add(("for", node[1], fold(node[2]), fold_block(node[3])))
        elif node[0] == "set":
            add(("set", node[1], fold(node[2])))
        elif node[0] == "generation":
            add(("generation", fold_block(node[1])))
        else:
            add(node)
    return out


# -- closures -----------------------------------------------------------------------------------
def closure(tree) -> Callable:
    """The expression as a function of the names."""
    kind = tree[0]
    if kind == "lit":
        return lambda env, v=tree[1]: v
    if kind == "name":
        return lambda env, n=tree[1]: env.get(n)
    if kind == "get":
        a, key = closure(tree[1]), closure(tree[2])

        def get(env):
            value, k = a(env), key(env)
            if isinstance(value, Mapping):
                return value.get(k)
            if isinstance(value, list) and isinstance(k, int):
                return value[k] if -len(value) <= k < len(value) else None
            return None
        return get
    if kind == "bin":
        op, a, b = _BINARY[tree[1]], closure(tree[2]), closure(tree[3])
        return lambda env: op(a(env), b(env))
    if kind == "filter":
        f, a, args = FILTERS[tree[1]], closure(tree[2]), [closure(x) for x in tree[3:]]
        return lambda env: f(a(env), *[x(env) for x in args])
    if kind == "not":
        a = closure(tree[1])
        return lambda env: not a(env)
    a, b = closure(tree[1]), closure(tree[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    c = closure(tree[3])                                    # choose
    return lambda env: b(env) if a(env) else c(env)


class Buffer:
    """Rendered text so far, and the spans written under ``generation``."""

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def add(self, text: str):
        self.parts.append(text)
        self.length += len(text)


def writer(body: list) -> Callable:
    """The statements as one function of (names, buffer)."""
    steps = [_step(node) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(env, out):
        for step in steps:
            step(env, out)
    return run


def _step(node) -> Callable:
    kind = node[0]
    if kind == "text":
        return lambda env, out, t=node[1]: out.add(t)
    if kind == "out":
        value = closure(node[1])
        return lambda env, out: out.add(_text(value(env)))
    if kind == "set":
        value, name = closure(node[2]), node[1]
        return lambda env, out: env.__setitem__(name, value(env))
    if kind == "generation":
        inner = writer(node[1])

        def generation(env, out):
            start = out.length
            inner(env, out)
            out.spans.append((start, out.length))
        return generation
    if kind == "if":
        branches, other = [(closure(c), writer(b)) for c, b in node[1]], writer(node[2])

        def decide(env, out):
            for cond, inner in branches:
                if cond(env):
                    return inner(env, out)
            return other(env, out)
        return decide
    items, inner, name = closure(node[2]), writer(node[3]), node[1]

    def loop(env, out):
        values = list(items(env) or [])
        for i, value in enumerate(values):
            inner(env | {name: value, "loop": {"index": i + 1, "first": i == 0, "last": i == len(values) - 1}}, out)
    return loop


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from names to (text, generation spans in code points)."""
    run = writer(fold_block(parse(source)))

    def render(names: dict):
        out = Buffer()
        run(dict(names), out)
        return "".join(out.parts), out.spans
    return render


# -- the chat format ----------------------------------------------------------------------------
CHAT = ("{% for m in messages %}{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
        "{% elif m.role == 'assistant' %}{{ '<' ~ 's>' }}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
        "{% else %}[TURN]{{ m.role | line | escape }}{{ '\\n' }}{{ m.text | escape }}[/TURN]{% endif %}{% endfor %}")
_TURNS = re.compile(r"\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|\[TURN\](.*?)\n(.*?)\[/TURN\]", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a text written by ``CHAT``."""
    turns, at = [], 0
    for m in _TURNS.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"stray text at {at}")
        at = m.end()
        if m[1] is not None:
            turns.append(("user", unescape_control(m[1])))
        elif m[2] is not None:
            turns.append(("assistant", unescape_control(m[2])))
        else:
            role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescape_control(m[3]))
            turns.append((role, unescape_control(m[4])))
    if at != len(formatted):
        raise ValueError(f"stray text at {at}")
    return turns


def format_chats(turns: DataFrame, template: str = CHAT) -> DataFrame:
    """One row per conversation: conv_id (as text), formatted, spans (array of start, end under the loss mask)."""
    chats = turns.groupBy(F.col("conv_id").cast("string").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")))).alias("messages"))

    def render(batches):
        fill = compile_template(template)
        for b in batches:
            done = [fill({"messages": list(m)}) for m in b["messages"]]
            yield pd.DataFrame({"conv_id": b["conv_id"], "formatted": [t for t, _ in done],
                                "spans": [[{"start": s, "end": e} for s, e in spans] for _, spans in done]})

    return chats.mapInPandas(render, "conv_id string, formatted string, spans array<struct<start:long,end:long>>")


def digest_chats(formatted: DataFrame) -> DataFrame:
    """Digests read back from the formatted text alone and its spans."""
    def digest(batches):
        for b in batches:
            rows = []
            for conv, text, spans in zip(b["conv_id"], b["formatted"], b["spans"], strict=True):
                turns = read_back(text)
                loss = "".join(unescape_control(text[s["start"]:s["end"]]) for s in spans)
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInPandas(digest, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, "
                                         "loss_sha256 string, formatted_chars long"
                                  ).withColumn("conv_id", F.col("conv_id").cast("long"))


SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|TURN\]))', '\1\2\\\3', 'g')) AS n,
 length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(/?(?:s>|INST\]|TURN\]))', '\1\2\\\3', 'g')) AS r FROM t)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(n + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + r END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
