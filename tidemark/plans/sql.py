"""A small SQL dialect over one table, lowered to a scan or to rows to append.

    SELECT (* | col [AS a] | fn(col) [AS a]), ... FROM t
      [WHERE col op literal [AND ...]] [GROUP BY col, ...]
      [ORDER BY col [ASC|DESC]] [LIMIT n] [OFFSET m]
    INSERT INTO t [(cols)] VALUES (literals) [, (literals)]...

What differs from standard SQL: an alias is read and not used (an aggregate is
called ``col_fn``); bounds on ``ts`` are inclusive, may be moments such as
'now-1h', and of two the last one holds; an unquoted word stands for its text; an aggregating
query is sorted by its first aggregate, downwards unless ORDER BY says
otherwise, and plain columns that it isn't grouped by are left out; a row query
is sorted by ts if that is selected, else by the ORDER BY column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from ..errors import SqlSyntaxError
from ..functions.interval import resolve
from ..operators.aggregates import BASIC
from ..operators.predicates import Condition
from ..operators.scan import Scan

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")
    |(?P<word>[A-Za-z_]\w*)
    |(?P<mark><=|>=|<>|!=|[(),=<>*;]))""",
    re.X | re.A,
)
_COMPARE = {"=": "eq", "!=": "ne", "<>": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
_RESERVED = {"SELECT", "FROM", "WHERE", "AND", "GROUP", "BY", "ORDER", "ASC", "DESC", "LIMIT", "OFFSET", "AS", "IN", "NOT", "IS", "NULL", "INSERT", "INTO", "VALUES", "TRUE", "FALSE"}


class Token(NamedTuple):
    kind: str
    text: str
    at: int

    @property
    def keyword(self) -> str:
        return self.text.upper() if self.kind == "word" and self.text.upper() in _RESERVED else ""


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql.rstrip()):
        m = _TOKEN.match(sql, at)
        if m is None:
            place = at + len(sql[at:]) - len(sql[at:].lstrip())
            said = "text without an end" if sql[place] in "'\"" else f"unexpected {sql[place]!r}"
            raise SqlSyntaxError(place, said)
        out.append(Token(m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
        at = m.end()
    return [*out, Token("end", "", len(sql))]


@dataclass
class Select:
    table: str
    columns: list[str] = field(default_factory=list)
    aggregates: list[tuple[str, str]] = field(default_factory=list)
    where: list[Condition] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    order_by: str | None = None
    order: str | None = None
    limit: int | None = None
    offset: int = 0
    star: bool = False


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list]


class _Reader:
    def __init__(self, sql: str):
        self.tokens, self.k = tokens(sql), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def fail(self, wanted: str):
        raise SqlSyntaxError(self.now.at, f"{wanted} expected, found {self.now.text or 'the end'!r}")

    def step(self) -> Token:
        self.k += 1
        return self.tokens[self.k - 1]

    def take(self, *words: str) -> bool:
        """Go over these keywords or marks if they come next."""
        if all((t.keyword or t.text) == w for t, w in zip(self.tokens[self.k :], words, strict=False)):
            self.k += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                self.fail(w)

    def name(self) -> str:
        if self.now.kind != "word" or self.now.keyword:
            self.fail("a name")
        return self.step().text

    def count(self) -> int:
        t = self.now
        if t.kind != "number" or not t.text.isdigit():
            self.fail("a whole number")
        return int(self.step().text)

    def literal(self):
        t = self.now
        if t.kind == "number":
            self.step()
            value = float(t.text)
            return int(value) if value.is_integer() and abs(value) < 1 << 53 else value
        if t.kind == "text":
            self.step()
            return t.text[1:-1].replace(t.text[0] * 2, t.text[0])
        if t.keyword in ("NULL", "TRUE", "FALSE"):
            self.step()
            return {"NULL": None, "TRUE": True, "FALSE": False}[t.keyword]
        if t.kind == "word" and not t.keyword:
            return self.step().text
        self.fail("a value")

    def listed(self, item) -> list:
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    def in_parentheses(self, item) -> list:
        self.need("(")
        out = self.listed(item)
        self.need(")")
        return out

    def end(self) -> None:
        self.take(";")
        if self.now.kind != "end":
            self.fail("the end")

    def statement(self) -> Select | Insert:
        if self.take("INSERT"):
            return self.insert()
        self.need("SELECT")
        return self.select()

    def insert(self) -> Insert:
        self.need("INTO")
        table = self.name()
        columns = self.in_parentheses(self.name) if self.now.text == "(" else None
        self.need("VALUES")
        at = self.now.at
        rows = self.listed(lambda: self.in_parentheses(self.literal))
        self.end()
        if columns is not None and any(len(r) != len(columns) for r in rows):
            raise SqlSyntaxError(at, "as many values as columns expected")
        return Insert(table, columns, rows)

    def select(self) -> Select:
        q = Select("")

        def item():
            if self.take("*"):
                q.star = True
                return
            word = self.name()
            if self.take("("):
                if word.lower() not in BASIC:
                    raise SqlSyntaxError(self.tokens[self.k - 2].at, f"a function of {', '.join(BASIC)} expected, found {word!r}")
                q.aggregates.append((self.name(), word.lower()))
                self.need(")")
            else:
                q.columns.append(word)
            if self.take("AS"):
                self.name()

        self.listed(item)
        self.need("FROM")
        q.table = self.name()
        if self.take("WHERE"):
            q.where.append(self.comparison())
            while self.take("AND"):
                q.where.append(self.comparison())
        if self.take("GROUP", "BY"):
            q.group_by = self.listed(self.name)
        if self.take("ORDER", "BY"):
            q.order_by = self.name()
            q.order = "desc" if self.take("DESC") else "asc"
            self.take("ASC")
        if self.take("LIMIT"):
            q.limit = self.count()
        if self.take("OFFSET"):
            q.offset = self.count()
        self.end()
        return q

    def comparison(self) -> Condition:
        name = self.name()
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return Condition(name, "isNotNull" if no else "isNull")
        if self.take("NOT"):
            self.need("IN")
            return Condition(name, "nin", self.in_parentheses(self.literal))
        if self.take("IN"):
            return Condition(name, "in", self.in_parentheses(self.literal))
        op = _COMPARE.get(self.now.text)
        if self.now.kind != "mark" or op is None:
            self.fail("a comparison")
        self.step()
        return Condition(name, op, self.literal())


def parse(sql: str) -> Select | Insert:
    """The statement in a text; SqlSyntaxError says where it can't be read."""
    return _Reader(sql).statement()


def lower(q: Select, now: int | None = None) -> Scan:
    """A SELECT as a scan."""
    start = end = None
    where = []
    for c in q.where:
        if c.field == "ts" and c.op in ("gt", "ge"):
            start = resolve(c.value, now)
        elif c.field == "ts" and c.op in ("lt", "le"):
            end = resolve(c.value, now)
        else:
            where.append(c)
    agg: dict[str, list[str]] = {}
    for name, fn in q.aggregates:
        if fn not in agg.setdefault(name, []):
            agg[name].append(fn)
    select: Sequence[str] = () if q.star or agg else q.columns
    return Scan(start=start, end=end, where=where, select=select, group_by=q.group_by if agg else (), agg=agg, order=q.order, limit=q.limit, offset=q.offset, key=q.order_by)
