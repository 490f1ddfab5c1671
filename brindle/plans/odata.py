"""The filter language: a lexer, a precedence parser, and a compiler to column predicates.

Document-level logic is two-valued. Each node compiles to a pair (pos, neg), neg being its complement over documents, so
negation swaps the pair and nothing has to be wrapped in coalesce, which would keep comparisons from the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.analysis import normalizer
from .schema import Field, Index, Path, RequestError

_TOKEN = re.compile(r"""\s*(?:(?P<geo>geography'(?:[^']|'')*')|(?P<str>'(?:[^']|'')*')|(?P<date>\d{4}-\d\d-\d\d(?:T\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d))?)
|(?P<num>-?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?)|(?P<word>[A-Za-z_][\w.]*(?:/[A-Za-z_]\w*)*)|(?P<op>[(),:]))""", re.X)
OPS = ("eq", "ne", "lt", "le", "gt", "ge")
FLIP = {"lt": "gt", "le": "ge", "gt": "lt", "ge": "le", "eq": "eq", "ne": "ne"}
NOT = {"lt": "ge", "le": "gt", "gt": "le", "ge": "lt", "eq": "ne", "ne": "eq"}


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise RequestError(f"unexpected {text[at:at + 10]!r} in the filter")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    """or < and < not < comparison. Nodes are tuples whose first member names them."""

    def __init__(self, text: str):
        self.tokens, self.at = lex(text), 0

    def peek(self, *words: str) -> bool:
        return self.tokens[self.at][1] in words and self.tokens[self.at][0] in ("word", "op")

    def take(self, word: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if word is not None and token[1] != word:
            raise RequestError(f"expected {word!r} but found {token[1]!r} in the filter")
        self.at += 1
        return token

    def parse(self) -> tuple:
        node = self.either()
        if self.tokens[self.at][0] != "end":
            raise RequestError(f"unexpected {self.tokens[self.at][1]!r} in the filter")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        left = self.operand()
        if self.peek(*OPS):
            op = self.take()[1]
            return ("cmp", op, left, self.operand())
        if self.peek("in"):
            self.take()
            self.take("(")
            values = [self.operand()]
            while self.peek(","):
                self.take()
                values.append(self.operand())
            self.take(")")
            return ("in", left, values)
        return left

    def operand(self) -> tuple:
        kind, text = self.take()
        if kind == "str":
            return ("lit", text[1:-1].replace("''", "'"))
        if kind == "geo":
            return ("geo", text[10:-1])
        if kind == "num":
            return ("lit", float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "date":
            return ("lit", datetime.fromisoformat(text.replace("Z", "+00:00") if "T" in text else text + "T00:00:00+00:00"))
        if text == "(":
            node = self.either()
            self.take(")")
            return node
        if kind != "word":
            raise RequestError(f"unexpected {text!r} in the filter")
        if text in ("true", "false", "null"):
            return ("lit", {"true": True, "false": False, "null": None}[text])
        if self.peek("("):
            self.take()
            head, _, last = text.rpartition("/")
            if last in ("any", "all") and head:
                if self.peek(")"):
                    self.take()
                    return (last, head, None, None)
                name = self.take()[1]
                self.take(":")
                body = self.either()
                self.take(")")
                return (last, head, name, body)
            args = []
            while not self.peek(")"):
                args.append(self.operand())
                if self.peek(","):
                    self.take()
            self.take(")")
            return ("call", text, args)
        return ("path", text)


Pair = tuple[Column, Column]


def coerce(value, field: Field):
    """A literal as the field's type: Int32 truncates toward zero; out of range or not of the kind gives Ellipsis, which matches nothing."""
    item = field.item
    if value is None:
        return None
    if item in ("Edm.Int32", "Edm.Int64"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise RequestError(f"{field.name} takes numbers")
        bits = 31 if item == "Edm.Int32" else 63
        return int(value) if -(2**bits) <= int(value) < 2**bits else ...
    if item == "Edm.Double":
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise RequestError(f"{field.name} takes numbers")
        return float(value)
    if item == "Edm.Boolean" and not isinstance(value, bool) or item == "Edm.String" and not isinstance(value, str):
        raise RequestError(f"{field.name} takes {item}")
    if item == "Edm.String" and field.normalizer:
        return Normal(value, field.normalizer)
    return value


class Normal(str):
    """A string literal compared in normalised form."""

    def __new__(cls, value: str, normalizer: str | dict):
        self = super().__new__(cls, value)
        self.normalizer = normalizer
        return self


def _lit(value) -> Column:
    return normalizer(value.normalizer)(F.lit(str(value))) if isinstance(value, Normal) else F.lit(value)


def _base(column: Column, field: Field) -> Column:
    return normalizer(field.normalizer)(column) if field.normalizer and field.item == "Edm.String" else column


def compare(column: Column, op: str, value) -> Pair:
    if value is ...:
        no, yes = F.lit(False), F.lit(True)
        return (yes, no) if op == "ne" else (no, yes)
    if value is None:
        pair = (column.isNull(), column.isNotNull())
        return pair if op == "eq" else pair[::-1]
    v = _lit(value)
    if op in ("eq", "ne"):
        pair = (column.eqNullSafe(v), ~column.eqNullSafe(v))
        return pair if op == "eq" else pair[::-1]
    apply = {"lt": lambda: column < v, "le": lambda: column <= v, "gt": lambda: column > v, "ge": lambda: column >= v}
    return apply[op](), apply[NOT[op]]() | column.isNull()


def split_list(text: str, delimiters: str = ", ") -> list[str]:
    parts = [p.strip() for p in re.split("[" + re.escape(delimiters) + "]", text)]
    return [p[1:-1].replace("''", "'") if len(p) > 1 and p[0] == p[-1] == "'" else p for p in parts if p]


def typed(text: str, field: Field):
    try:
        if field.item in ("Edm.Int32", "Edm.Int64"):
            return int(text)
        if field.item == "Edm.Double":
            return float(text)
        if field.item == "Edm.Boolean":
            return {"true": True, "false": False}[text.lower()]
        if field.item == "Edm.DateTimeOffset":
            return datetime.fromisoformat(text.replace("Z", "+00:00"))
    except (ValueError, KeyError):
        return ...
    return Normal(text, field.normalizer) if field.normalizer else text


class Compiler:
    """text_match(query, fields, syntax, mode) gives the predicate of search.ismatch."""

    def __init__(self, index: Index, text_match: Callable[..., Column] | None = None):
        self.index, self.text_match = index, text_match

    def filter(self, text: str) -> Column:
        return self.node(Parser(text).parse())[0]

    def path(self, name: str) -> Path | None:
        found = self.index.find(name)
        if found and not found.leaf.filterable:
            raise RequestError(f"{name} is not filterable")
        return found

    def node(self, n: tuple) -> Pair:
        kind = n[0]
        if kind in ("and", "or"):
            (a, na), (b, nb) = self.node(n[1]), self.node(n[2])
            return (a & b, na | nb) if kind == "and" else (a | b, na & nb)
        if kind == "not":
            return self.node(n[1])[::-1]
        if kind == "cmp":
            return self.comparison(n)
        if kind == "in":
            if n[1][0] != "path" or any(v[0] != "lit" or not isinstance(v[1], str) for v in n[2]):
                raise RequestError("in takes a field and strings")
            return self.listed(n[1][1], [v[1] for v in n[2]], False)
        if kind in ("any", "all"):
            return self.lambda_(n)
        if kind == "call":
            return self.call(n)
        raise RequestError("a filter is made of comparisons of a field with a literal")

    def comparison(self, n: tuple) -> Pair:
        _, op, left, right = n
        if left[0] == "call" and left[1] == "geo.distance" or right[0] == "call" and right[1] == "geo.distance":
            call, lit, op = (left, right, op) if left[0] == "call" else (right, left, FLIP[op])
            return self.distance(call, op, lit)
        if left[0] == "cmp" or left[0] == "not" or left[0] != "path" or right[0] != "lit":
            raise RequestError("a comparison takes a field on the left and a literal on the right")
        path = self.path(left[1])
        if path is None:
            no, yes = F.lit(False), F.lit(True)
            pair = (yes, no) if right[1] is None else (no, yes)
            return pair[::-1] if op == "ne" else pair
        return self.leaf(path, op, right[1])

    def leaf(self, path: Path, op: str, raw) -> Pair:
        column = path.column()
        if raw is None:
            if op not in ("eq", "ne"):
                raise RequestError("null is compared with eq or ne")
            pair = self.missing(path, column)
            return pair if op == "eq" else pair[::-1]
        if path.leaf.item == "Edm.Boolean" and op not in ("eq", "ne"):
            raise RequestError("booleans are compared with eq or ne")
        value = coerce(raw, path.leaf)
        if path.many:
            if op == "ne":
                return self.some(column, lambda x: compare(_base(x, path.leaf), "eq", value)[0])[::-1]
            return self.some(column, lambda x: compare(_base(x, path.leaf), op, value)[0])
        return compare(_base(column, path.leaf), op, value)

    def missing(self, path: Path, column: Column) -> Pair:
        if path.many or path.leaf.collection:
            has = F.coalesce(F.exists(column, lambda x: x.isNotNull()), F.lit(False))
            return ~has, has
        if path.leaf.complex:
            pairs = [self.missing(Path((*path.fields, f)), Path((*path.fields, f)).column()) for f in path.leaf.fields]
            pos, neg = pairs[0]
            for p, q in pairs[1:]:
                pos, neg = pos & p, neg | q
            return pos, neg
        return column.isNull(), column.isNotNull()

    def some(self, column: Column, test: Callable[[Column], Column]) -> Pair:
        hit = F.exists(column, lambda x: F.coalesce(test(x), F.lit(False)) & x.isNotNull())
        return F.coalesce(hit, F.lit(False)), F.coalesce(~hit, F.lit(True))

    def listed(self, name: str, values: list, typed_values: bool) -> Pair:
        path = self.path(name)
        values = [v for v in (typed(v, path.leaf) if typed_values else coerce(v, path.leaf) for v in values) if v is not ...] if path else []
        if not values:
            return F.lit(False), F.lit(True)
        test = lambda x: _base(x, path.leaf).isin([_lit(v) for v in values])
        column = path.column()
        if path.many or path.leaf.collection:
            return self.some(column, test)
        return test(column), ~test(column) | column.isNull()

    def distance(self, call: tuple, op: str, lit: tuple) -> Pair:
        if op in ("eq", "ne") or lit[0] != "lit":
            raise RequestError("geo.distance is compared with lt, le, gt or ge")
        path, (lon, lat) = self.geo(call, geo.parse_point)
        km = float(lit[1])
        if path.many or path.leaf.collection:
            return self.some(path.column(), lambda p: compare(geo.distance_km(p, lon, lat), op, km)[0])
        point = path.column()
        pos, neg = compare(geo.distance_km(point, lon, lat), op, km)
        if op in ("lt", "le"):
            pos = geo.within_box(point, lon, lat, km) & pos
        return pos, neg

    def geo(self, call: tuple, parse) -> tuple[Path, object]:
        args = call[2]
        names, shapes = [a for a in args if a[0] == "path"], [a for a in args if a[0] == "geo"]
        if len(names) != 1 or len(shapes) != 1:
            raise RequestError(f"{call[1]} takes a field and a shape")
        try:
            return self.path(names[0][1]) or self.index.need(names[0][1]), parse(shapes[0][1])
        except ValueError as e:
            raise RequestError(str(e)) from e

    def call(self, n: tuple) -> Pair:
        _, name, args = n
        if name == "search.in":
            return self.listed(args[0][1], split_list(args[1][1], *([args[2][1]] if len(args) > 2 else [])), True)
        if name == "geo.intersects":
            path, ring = self.geo(n, geo.parse_polygon)
            if path.many or path.leaf.collection:
                return self.some(path.column(), lambda p: geo.in_polygon(p, ring))
            hit = geo.in_polygon(path.column(), ring)
            return hit, ~hit
        if name in ("search.ismatch", "search.ismatchscoring") and self.text_match:
            hit = self.text_match(*(a[1] for a in args))
            return hit, ~hit
        raise RequestError(f"unknown function {name}")

    def lambda_(self, n: tuple) -> Pair:
        which, name, variable, body = n
        path = self.path(name) or self.index.need(name)
        column = path.column()
        if not path.leaf.collection:
            raise RequestError(f"{name} is no collection")
        if body is None:
            if which == "all":
                raise RequestError("all takes a condition")
            return self.some(column, lambda x: F.lit(True))
        if path.leaf.complex:
            test = lambda x: Element(path.leaf, variable, x).test(body)
            if which == "any":
                return self.some(column, test)
            fails = self.some(column, lambda x: ~test(x))
            return fails[::-1]
        return self.primitive(path, column, variable, body, which == "all")

    def primitive(self, path: Path, column: Column, variable: str, n: tuple, every: bool) -> Pair:
        """any: each comparison is a test of the whole collection, so they are not tied to one element. all: none fails a single one."""
        kind = n[0]
        if kind in ("and", "or"):
            if every:
                raise RequestError("all over plain values takes one condition")
            (a, na), (b, nb) = (self.primitive(path, column, variable, x, False) for x in n[1:])
            return (a & b, na | nb) if kind == "and" else (a | b, na & nb)
        if kind == "not":
            if every:
                inner = n[1]
                if inner[0] == "cmp":
                    return self.primitive(path, column, variable, ("cmp", NOT[inner[1]], *inner[2:]), True)
                return self.primitive(path, column, variable, inner, False)[::-1]
            return self.primitive(path, column, variable, n[1], False)[::-1]
        if kind == "cmp" and n[2] == ("path", variable):
            op, value = n[1], coerce(n[3][1], path.leaf)
            if every and op == "eq":
                raise RequestError("all over plain values doesn't take eq")
            test = lambda o: self.some(column, lambda x: compare(_base(x, path.leaf), o, value)[0])
            if op == "ne":
                return test("eq")[::-1]
            return test(NOT[op])[::-1] if every else test(op)
        if kind == "cmp":
            call, lit, op = (n[2], n[3], n[1]) if n[2][0] == "call" else (n[3], n[2], FLIP[n[1]])
            if call[0] == "call" and call[1] == "geo.distance":
                shape = next(a[1] for a in call[2] if a[0] == "geo")
                lon, lat = geo.parse_point(shape)
                test = lambda o: self.some(column, lambda p: compare(geo.distance_km(p, lon, lat), o, float(lit[1]))[0])
                return test(NOT[op])[::-1] if every else test(op)
        if kind == "call" and n[1] == "search.in":
            values = [v for v in (typed(v, path.leaf) for v in split_list(n[2][1][1], *([n[2][2][1]] if len(n[2]) > 2 else []))) if v is not ...]
            test = lambda x: _base(x, path.leaf).isin([_lit(v) for v in values]) if values else F.lit(False)
            return self.some(column, lambda x: ~test(x))[::-1] if every else self.some(column, test)
        if kind == "call" and n[1] == "geo.intersects":
            ring = geo.parse_polygon(next(a[1] for a in n[2] if a[0] == "geo"))
            return self.some(column, lambda x: ~geo.in_polygon(x, ring))[::-1] if every else self.some(column, lambda x: geo.in_polygon(x, ring))
        raise RequestError("not a condition on the collection's values")


class Element:
    """Conditions on one element of a complex collection; all of them hold for the same element. Null fails all but eq null."""

    def __init__(self, owner: Field, variable: str, root: Column, outer: Element | None = None):
        self.owner, self.variable, self.root, self.outer = owner, variable, root, outer

    def resolve(self, name: str) -> tuple[Path, Column]:
        head, _, rest = name.partition("/")
        at = self
        while at is not None and at.variable != head:
            at = at.outer
        if at is None:
            raise RequestError(f"{head} is not a variable of this lambda")
        fields, found = at.owner.fields, []
        for part in rest.split("/"):
            f = next((f for f in fields if f.name.lower() == part.lower()), None)
            if f is None:
                raise RequestError(f"unknown field {name}")
            found.append(f)
            fields = f.fields
        return Path(tuple(found)), Path(tuple(found)).column(at.root)

    def test(self, n: tuple) -> Column:
        kind = n[0]
        if kind == "and":
            return self.test(n[1]) & self.test(n[2])
        if kind == "or":
            return self.test(n[1]) | self.test(n[2])
        if kind == "not":
            return ~self.test(n[1])
        if kind == "path":
            return F.coalesce(self.resolve(n[1])[1], F.lit(False))
        if kind in ("any", "all"):
            path, column = self.resolve(n[1])
            if n[3] is None:
                return F.coalesce(F.exists(column, lambda x: x.isNotNull()), F.lit(False))
            if path.leaf.complex:
                inner = lambda x: Element(path.leaf, n[2], x, self).test(n[3])
            else:
                inner = lambda x: Value(path.leaf, n[2], x).test(n[3])
            if kind == "any":
                return F.coalesce(F.exists(column, lambda x: x.isNotNull() & inner(x)), F.lit(False))
            return F.coalesce(~F.exists(column, lambda x: x.isNotNull() & ~inner(x)), F.lit(True))
        if kind == "call" and n[1] == "search.in":
            path, column = self.resolve(n[2][0][1])
            texts = [p.strip() for p in re.split("[" + re.escape(n[2][2][1] if len(n[2]) > 2 else ", ") + "]", n[2][1][1])]
            return F.coalesce(column.isin([t for t in texts if t]), F.lit(False)) if path.leaf.item == "Edm.String" else F.lit(False)
        if kind == "call" and n[1] == "geo.intersects":
            ring = geo.parse_polygon(next(a[1] for a in n[2] if a[0] == "geo"))
            return geo.in_polygon(self.resolve(next(a[1] for a in n[2] if a[0] == "path"))[1], ring)
        if kind == "cmp":
            op, left, right = n[1:]
            if left[0] == "lit":
                op, left, right = FLIP[op], right, left
            if left[0] == "call" and left[1] == "geo.distance":
                lon, lat = geo.parse_point(next(a[1] for a in left[2] if a[0] == "geo"))
                column = geo.distance_km(self.resolve(next(a[1] for a in left[2] if a[0] == "path"))[1], lon, lat)
                return F.coalesce(compare(column, op, float(right[1]))[0], F.lit(False))
            if left[0] == "path" and right[0] == "lit":
                path, column = self.resolve(left[1])
                if right[1] is None:
                    return compare(column, op, None)[0]
                value = right[1]
                fits = isinstance(value, str) == (path.leaf.item == "Edm.String") and isinstance(value, bool) == (path.leaf.item == "Edm.Boolean")
                return F.coalesce({"eq": column == value, "ne": column != value, "lt": column < value, "le": column <= value, "gt": column > value, "ge": column >= value}[op], F.lit(False)) if fits else F.lit(False)
        raise RequestError("not a condition on the collection's elements")


class Value(Element):
    """Conditions on one plain value within an element."""

    def resolve(self, name: str) -> tuple[Path, Column]:
        if name != self.variable:
            raise RequestError(f"{name} is not a variable of this lambda")
        return Path((Field("value", self.owner.item),)), self.root
