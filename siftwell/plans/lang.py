"""The boolean query language: lexer, parser, and compilation to one narrow plan.

    [COUNT] condition [SORT BY ((field ASC|DESC), ...)]

A condition compiles to two Columns: whether a document is in the result, and how often. OR adds
(a bag union, duplicates stay), AND keeps the left side's times where the right side has the
document, NOT is a word's absence. So any query is a single scan without a join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.operators.collection import Collection


class QueryError(ValueError):
    """A query that can't be read, or compares what can't be compared."""


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str | int


@dataclass(frozen=True)
class And:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Or:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not:
    inner: Expr


@dataclass(frozen=True)
class Count:
    inner: Expr


@dataclass(frozen=True)
class Sort:
    inner: Expr
    fields: tuple[tuple[str, bool], ...]  # name, ascending


Expr = Compare | And | Or | Not | Count | Sort
KEYWORDS = {"AND", "OR", "NOT", "ASC", "DESC", "COUNT", "SORT", "BY"}
_TOKEN = re.compile(r"\s*(?:(?P<sign>>=|<=|[()=<>,])|(?P<number>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*))")


def tokenize(text: str) -> list[tuple[str, str | int]]:
    """(kind, value) pairs; kinds are signs, keywords, "number" and "name"."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character at {at}: {text[at:].lstrip()[:1]!r}")
        at = m.end()
        if m["number"]:
            if int(m["number"]) >= 1 << 63:
                raise QueryError(f"number too large: {m['number']}")
            out.append(("number", int(m["number"])))
        elif m["name"]:
            word = m["name"].upper()
            out.append((word, word) if word in KEYWORDS else ("name", m["name"]))
        else:
            out.append((m["sign"], m["sign"]))
    return out


class _Parser:
    def __init__(self, tokens: list[tuple[str, str | int]]):
        self.tokens, self.at = tokens, 0

    def have(self, kind: str) -> bool:
        hit = self.at < len(self.tokens) and self.tokens[self.at][0] == kind
        self.at += hit
        return hit

    def need(self, *kinds: str) -> str | int:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in kinds:
            self.at += 1
            return self.tokens[self.at - 1][1]
        found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
        raise QueryError(f"expected {' or '.join(kinds)}, found {found}")

    def query(self) -> Expr:
        e: Expr = Count(self.any_of()) if self.have("COUNT") else self.any_of()
        if self.have("SORT"):
            self.need("BY")
            self.need("(")
            fields = []
            while True:
                self.need("(")
                name = self.need("name")
                fields.append((name, self.need("ASC", "DESC") == "ASC"))
                self.need(")")
                if not self.have(","):
                    break
            self.need(")")
            e = Sort(e, tuple(fields))
        if self.at < len(self.tokens):
            raise QueryError(f"expected the end, found {self.tokens[self.at][1]}")
        return e

    def any_of(self) -> Expr:
        e = self.all_of()
        while self.have("OR"):
            e = Or(e, self.all_of())
        return e

    def all_of(self) -> Expr:
        e = self.negated()
        while self.have("AND"):
            e = And(e, self.negated())
        return e

    def negated(self) -> Expr:
        if self.have("NOT"):
            return Not(self.negated())
        if self.have("("):
            e = self.any_of()
            self.need(")")
            return e
        return Compare(self.need("name"), self.need("=", ">", ">=", "<", "<="), self.need("name", "number"))


def parse(text: str) -> Expr:
    return _Parser(tokenize(text)).query()


def holds(c: Collection, e: Expr) -> Column:
    """Whether a document is in the result of a condition; what the scan can use of it, it does."""
    if isinstance(e, Compare):
        if e.op == "=" and isinstance(e.value, str):
            return c.has_any([e.value])  # whatever the field
        if e.op == "=" or isinstance(e.value, str):
            raise QueryError(f"invalid comparison: {e.field} {e.op} {e.value}")
        low = {">": e.value + 1, ">=": e.value}.get(e.op)
        high = {"<": e.value - 1, "<=": e.value}.get(e.op)
        return c.has_value(e.field, None if low is None else X.scaled(low), None if high is None else X.scaled(high))
    if isinstance(e, Or):
        return holds(c, e.left) | holds(c, e.right)
    if isinstance(e, And):
        return holds(c, e.left) & holds(c, e.right)
    if isinstance(e, Not):
        if not (isinstance(e.inner, Compare) and e.inner.op == "=" and isinstance(e.inner.value, str)):
            raise QueryError("NOT takes a word comparison only")
        return ~c.has_any([e.inner.value])
    raise QueryError("COUNT and SORT BY stand outside of conditions")


def times(c: Collection, e: Expr) -> Column | None:
    """How often a document that is in the result is there; None for always once."""
    if isinstance(e, And):
        return times(c, e.left)
    if not isinstance(e, Or):
        return None

    def of(x: Expr) -> Column:
        n = times(c, x)
        return F.when(holds(c, x), F.lit(1).cast("long") if n is None else n).otherwise(F.lit(0).cast("long"))

    return of(e.left) + of(e.right)


def run(c: Collection, query: str | Expr) -> DataFrame:
    """(doc_id) of the result, as often as it is in it, in order if the query sorts; with COUNT also ``count``.

    All errors are raised here, before any job.
    """
    e = parse(query) if isinstance(query, str) else query
    fields: tuple[tuple[str, bool], ...] = ()
    if isinstance(e, Sort):
        e, fields = e.inner, e.fields
    counted = isinstance(e, Count)
    if counted:
        e = e.inner
    inside, n = holds(c, e), times(c, e)
    keys, order = c.sort_columns(fields)
    hits = c.base.where(inside).select("doc_id", *([n.alias("times")] if n is not None else []), *keys)
    if counted:
        hits = hits.crossJoin(F.broadcast(count(c, e)))  # one row
    out = hits if n is None else hits.withColumn("times", F.explode_outer(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")
    if fields:
        out = out.orderBy(*order, F.col("doc_id").asc())
    return out.select("doc_id", *(["count"] if counted else []))


def count(c: Collection, query: str | Expr) -> DataFrame:
    """One row: the size of the result's bag."""
    e = parse(query) if isinstance(query, str) else query
    while isinstance(e, (Sort, Count)):
        e = e.inner
    n = times(c, e)
    return c.base.where(holds(c, e)).agg(F.coalesce(F.sum(F.lit(1).cast("long") if n is None else n), F.lit(0).cast("long")).alias("count"))
