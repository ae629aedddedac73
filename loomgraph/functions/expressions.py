"""The expression language: a small parser that emits columns, so that Catalyst optimises what a definition says.

Literals (numbers, "strings", true, false, nil, [arrays]), dotted paths from the roots ``inputs`` and ``state``,
``+ - * / %``, comparisons, ``&& || !`` and parentheses. An unknown name, a function call or anything else is a
CompileError when the plan is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.truth import text, truthy


class CompileError(ValueError):
    """An expression or template that can't be compiled."""


@dataclass(frozen=True)
class Value:
    """A column and its type, of a constant its value, and of a list that was written out its items."""

    column: Column
    kind: T.DataType
    const: object = None
    items: tuple = ()


#: Another engine may take the place of this one: anything that makes a value of code and a scope.
Engine = Callable[[str, "Scope"], Value]


@dataclass
class Scope:
    """Where paths lead: columns of df by root and name, and typed values that are bound for a while (Each). engine: what
    evaluates expressions, if not this language."""

    df: DataFrame
    inputs: dict[str, str]
    state: dict[str, str]
    bound: dict[str, Value] | None = None
    engine: Engine | None = None

    def resolve(self, path: list[str]) -> Value:
        root, *rest = path
        if root not in ("inputs", "state") or not rest:
            raise CompileError(f"undefined name {'.'.join(path)!r}")
        if root == "state" and self.bound and rest[0] in self.bound:
            out = self.bound[rest[0]]
        else:
            names = self.inputs if root == "inputs" else self.state
            if rest[0] not in names:
                raise CompileError(f"undefined name {'.'.join(path)!r}")
            name = names[rest[0]]
            out = Value(F.col(f"`{name}`"), self.df.schema[name].dataType)
        for part in rest[1:]:
            if isinstance(out.kind, T.StructType) and part in out.kind.names:
                out = Value(out.column[part], out.kind[part].dataType)
            elif isinstance(out.kind, T.MapType):
                out = Value(out.column[part], out.kind.valueType)
            elif isinstance(out.kind, T.VariantType):
                out = Value(F.variant_get(out.column, f"$.{part}", "variant"), T.VariantType())
            else:
                raise CompileError(f"undefined name {'.'.join(path)!r}")
        return out


_TOKEN = re.compile(r'\s*(?:(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||[<>=!]=|[-+*/%<>!().,\[\]]))')
_LEVELS = [["||"], ["&&"], ["==", "!=", "<", "<=", ">", ">="], ["+", "-"], ["*", "/", "%"]]


def _tokens(code: str) -> list[tuple[str, str]]:
    out, at, code = [], 0, code.rstrip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if not m:
            raise CompileError(f"unexpected {code[at:at + 10]!r} in {code!r}")
        out.append((m.lastgroup or "", m[m.lastgroup or 0]))
        at = m.end()
    if not out:
        raise CompileError("empty expression")
    return out


class _Parser:
    def __init__(self, code: str):
        self.code, self.tokens, self.at = code, _tokens(code), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, want: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or (want and token[1] != want):
            raise CompileError(f"expected {want or 'more'} in {self.code!r}")
        self.at += 1
        return token

    def whole(self):
        tree = self.binary(0)
        if self.peek()[0] != "end":
            raise CompileError(f"unexpected {self.peek()[1]!r} in {self.code!r}")
        return tree

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek()[0] == "op" and self.peek()[1] in _LEVELS[level]:
            op = self.take()[1]
            left = ("binary", op, left, self.binary(level + 1))
        return left

    def unary(self):
        if self.peek() in (("op", "!"), ("op", "-")):
            return ("unary", self.take()[1], self.unary())
        return self.primary()

    def primary(self):
        kind, word = self.take()
        if kind == "num":
            return ("literal", float(word) if re.search(r"[.eE]", word) else int(word))
        if kind == "str":
            return ("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1]))
        if kind == "name":
            if word in ("true", "false", "nil"):
                return ("literal", {"true": True, "false": False, "nil": None}[word])
            path = [word]
            while self.peek() == ("op", "."):
                self.take()
                kind, word = self.take()
                if kind != "name":
                    raise CompileError(f"expected a field name in {self.code!r}")
                path.append(word)
            if self.peek() == ("op", "("):
                raise CompileError(f"unknown function {'.'.join(path)!r}")
            return ("path", path)
        if word == "(":
            tree = self.binary(0)
            self.take(")")
            return tree
        if word == "[":
            items = []
            while self.peek() != ("op", "]"):
                items.append(self.binary(0))
                if self.peek() == ("op", ","):
                    self.take()
                elif self.peek() != ("op", "]"):
                    raise CompileError(f"expected ] in {self.code!r}")
            self.take()
            return ("array", items)
        raise CompileError(f"unexpected {word!r} in {self.code!r}")


def parse(code: str):
    return _Parser(code).whole()


def _literal(v) -> Value:
    kind = {type(None): T.NullType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}[type(v)]
    return Value(F.lit(v).cast("bigint") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v), kind, v)


def _build(tree, scope: Scope) -> Value:
    what = tree[0]
    if what == "literal":
        return _literal(tree[1])
    if what == "path":
        return scope.resolve(tree[1])
    if what == "array":
        items = [_build(t, scope) for t in tree[1]]
        kinds = {type(v.kind) for v in items}
        if len(kinds) > 1:
            raise CompileError("the items of an array must have one type")
        return Value(F.array(*(v.column for v in items)), T.ArrayType(items[0].kind if items else T.StringType()))
    if what == "unary":
        v = _build(tree[2], scope)
        if tree[1] == "!":
            return Value(~truthy(v.column, v.kind), T.BooleanType())
        if not isinstance(v.kind, T.NumericType):
            raise CompileError("- needs a number")
        return Value(-v.column, v.kind)
    op, a, b = tree[1], _build(tree[2], scope), _build(tree[3], scope)
    if op in ("&&", "||"):
        x, y = truthy(a.column, a.kind), truthy(b.column, b.kind)
        return Value(x & y if op == "&&" else x | y, T.BooleanType())
    if op in ("==", "!="):
        same = a.column.eqNullSafe(b.column)
        return Value(same if op == "==" else ~same, T.BooleanType())
    if op in ("<", "<=", ">", ">="):
        x, y = a.column, b.column
        return Value(F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False)), T.BooleanType())
    if op == "+" and isinstance(a.kind, T.StringType) and isinstance(b.kind, T.StringType):
        return Value(F.concat(a.column, b.column), T.StringType())
    if not (isinstance(a.kind, T.NumericType) and isinstance(b.kind, T.NumericType)):
        raise CompileError(f"{op} needs two numbers{' or two strings' if op == '+' else ''}")
    whole = isinstance(a.kind, T.IntegralType) and isinstance(b.kind, T.IntegralType)
    kind = T.LongType() if whole else T.DoubleType()
    x, y = a.column, b.column
    if op == "/":
        return Value((F.expr("1") * x / y).cast("bigint") if whole else x / y, kind)
    return Value({"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op].cast(kind), kind)


def evaluate(code: str, scope: Scope) -> Value:
    """The value of an expression, by the scope's engine if it has one."""
    return scope.engine(code, scope) if scope.engine else _build(parse(code), scope)


def predicate(code: str | None, scope: Scope) -> Column:
    """An edge's condition: none, true and false (trimmed, in any case) are constants; else the expression's truth."""
    plain = (code or "true").strip().lower()
    if plain in ("true", "false"):
        return F.lit(plain == "true")
    v = evaluate(code, scope)
    return truthy(v.column, v.kind)


def parts(raw: str) -> list[tuple[str, str]]:
    """A template as ("text" or "code", ...) parts."""
    out, at = [], 0
    while (i := raw.find("${", at)) >= 0:
        j = raw.find("}", i)
        if j < 0 or not raw[i + 2 : j].strip():
            raise CompileError(f"malformed template {raw!r}")
        if i > at:
            out.append(("text", raw[at:i]))
        out.append(("code", raw[i + 2 : j]))
        at = j + 1
    if at < len(raw):
        out.append(("text", raw[at:]))
    return out


def template(raw: str, scope: Scope) -> Value:
    """Text without ${...} is itself; one expression alone keeps its type; mixed, all is joined as text."""
    found = parts(raw)
    if not any(k == "code" for k, _ in found):
        return _literal(raw)
    inked = [p for p in found if p[0] == "code" or p[1].strip()]
    if len(inked) == 1:
        return evaluate(inked[0][1], scope)
    return Value(F.concat(*(F.lit(s) if k == "text" else template_text(s, scope) for k, s in found)), T.StringType())


def template_text(code: str, scope: Scope) -> Column:
    v = evaluate(code, scope)
    return text(v.column, v.kind)


def parameters(value, scope: Scope) -> Value:
    """A parameter: templates in texts are evaluated, in maps and lists as well; maps become structs."""
    if isinstance(value, str):
        return template(value, scope)
    if isinstance(value, dict):
        items = {k: parameters(v, scope) for k, v in value.items()}
        return Value(F.struct(*(v.column.alias(k) for k, v in items.items())), T.StructType([T.StructField(k, v.kind) for k, v in items.items()]))
    if isinstance(value, list):
        items = [parameters(v, scope) for v in value]
        # of items of several types, the array holds texts
        mixed = len({v.kind.simpleString() for v in items}) > 1 and not all(isinstance(v.kind, T.NumericType) for v in items)
        columns = [text(v.column, v.kind) for v in items] if mixed else [v.column for v in items]
        return Value(F.array(*columns), T.ArrayType(T.StringType() if mixed or not items else items[0].kind), items=tuple(items))
    return _literal(value)
