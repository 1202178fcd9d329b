"""The filter language: text to syntax tree to Column.

Logic is two-valued: a row is in a set or not, and `not` is the complement. In discrete columns null is
an ordinary value that sorts before all others; in scalar columns null is in no comparison. `not` is
driven down to the comparisons, where it becomes a plain condition or a null test, so that no filter hides
from the scan behind a coalesce.
"""

from __future__ import annotations

import ast
import calendar
import datetime as dt
import re
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, functions as F, types as T

from tallyframe.plans import textsearch

if TYPE_CHECKING:
    from tallyframe.meta import Dataset


class FilterError(ValueError):
    """A filter that cannot be read or does not suit its column."""


#: The spellings of each comparison. A spelling followed by a colon compares prefixes.
SPELLINGS = {
    "eq": ["=", "==", "eq", "equals", "equalto", "equal to", "equal"],
    "ne": ["!=", "<>", "#", "!==", "ne", "notequal", "notequalto", "doesnotequal", "does not equal", "not equal", "not equal to"],
    "lt": ["<", "lt", "lessthan", "less than"],
    "le": ["<=", "=<", "le", "lessequal", "lessthanorequalto", "less than or equal to", "less or equal"],
    "gt": [">", "gt", "greaterthan", "greater than"],
    "ge": [">=", "=>", "ge", "greaterequal", "greaterthanorequalto", "greater than or equal to", "greater or equal"],
    "in": ["in"],
    "notin": ["notin", "not in"],
}
#: Spellings that compare prefixes without a colon.
PREFIX_SPELLINGS = {
    "eq": ["startingwith", "startswith", "starting with", "starts with"],
    "ne": ["notstartingwith", "notstartswith", "not starting with", "not startswith", "not starts with"],
}
OPERATORS: dict[tuple[str, ...], tuple[str, bool]] = {("between",): ("between", False), ("contains",): ("contains", False)}
for _op, _names in SPELLINGS.items():
    for _n in _names:
        OPERATORS[tuple(_n.split())] = (_op, False)
        OPERATORS[tuple((_n + ":").split())] = (_op, True)
for _op, _names in PREFIX_SPELLINGS.items():
    for _n in _names:
        OPERATORS[tuple(_n.split())] = (_op, True)
_LONGEST = max(map(len, OPERATORS))

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<search>\[\[.*?\]\])
    | (?P<string>[rR]?'(?:[^\n'\\]|\\.)*'|[rR]?"(?:[^\n"\\]|\\.)*")
    | (?P<isodate>\d{4}-\d{1,2}-\d{1,2})
    | (?P<number>[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?(?![A-Za-z_0-9]))
    | (?P<word>[A-Za-z_0-9]+:?)
    | (?P<symbol>(?:!==|==|!=|<>|<=|=<|>=|=>|=|<|>|\#):?)
    | (?P<punct>[(),])
    )""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    prefix: bool
    value: Any


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Negation:
    part: Any


@dataclass(frozen=True)
class RelativeDate:
    """A day relative to today; at most one of years, months and days."""

    years: int = 0
    months: int = 0
    days: int = 0
    align: str = ""

    def resolve(self, now: dt.date | dt.datetime | None) -> dt.date:
        day = now or dt.date.today()
        day = day.date() if isinstance(day, dt.datetime) else day
        shift = 12 * self.years + self.months
        if shift:
            y, m = divmod(day.year * 12 + day.month - 1 + shift, 12)
            day = dt.date(y, m + 1, min(day.day, calendar.monthrange(y, m + 1)[1]))
        day += dt.timedelta(days=self.days)
        align = self.align.lower()
        names = [n.lower() for n in calendar.day_name]
        if align in names:
            # The weekday of the same week, which starts on Monday.
            return day - dt.timedelta(days=day.weekday() - names.index(align))
        if align in ("bom", "1st", "som"):
            return day.replace(day=1)
        if align in ("boy", "soy"):
            return day.replace(month=1, day=1)
        return day


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0
        self.tokens: list[tuple[str, str]] = []
        pos = 0
        while text[pos:].strip():
            m = _TOKEN.match(text, pos)
            if not m:
                raise FilterError(f"cannot read filter at {text[pos : pos + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def accept(self, value: str) -> bool:
        if self.peek()[1] == value and self.peek()[0] in ("word", "punct", "symbol"):
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.accept(value):
            raise FilterError(f"expected {value!r} but found {self.peek()[1]!r} in {self.text!r}")

    def either(self) -> Any:
        parts = [self.both()]
        while self.accept("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def both(self) -> Any:
        parts = [self.comparison()]
        while self.accept("and"):
            parts.append(self.comparison())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def comparison(self) -> Any:
        if self.accept("("):
            inner = self.either()
            self.expect(")")
            return inner
        if self.peek() == ("word", "not") and not self._operator(self.at + 1):
            self.at += 1
            return Negation(self.comparison())
        kind, column = self.take()
        if kind not in ("word", "number") or not re.fullmatch(r"\w+", column):
            raise FilterError(f"expected a column but found {column!r} in {self.text!r}")
        found = self._operator(self.at)
        if not found:
            raise FilterError(f"expected an operator after {column!r} in {self.text!r}")
        op, prefix, used = found
        self.at += used
        value = self.term()
        if op in ("in", "notin") and not isinstance(value, tuple):
            raise FilterError(f"{op} needs a list in parentheses")
        if op == "between" and (not isinstance(value, tuple) or len(value) != 2):
            raise FilterError("between needs two values in parentheses")
        return Compare(column, op, prefix, value)

    def _operator(self, at: int) -> tuple[str, bool, int] | None:
        """The longest spelling that starts at a token."""
        words = [v.lower() for k, v in self.tokens[at : at + _LONGEST] if k in ("word", "symbol")]
        for n in range(len(words), 0, -1):
            if hit := OPERATORS.get(tuple(words[:n])):
                return *hit, n
        return None

    def term(self) -> Any:
        kind, v = self.take()
        if kind == "number":
            return int(v) if re.fullmatch(r"[-+]?\d+", v) else float(v)
        if kind == "string":
            return ast.literal_eval(v)
        if kind == "search":
            return textsearch.parse(v[2:-2])
        if (kind, v) == ("punct", "("):
            items = [self.term()]
            while self.accept(","):
                items.append(self.term())
            self.expect(")")
            return tuple(items)
        if v == "date":
            if self.peek()[0] == "isodate":
                return dt.date(*map(int, self.take()[1].split("-")))
            parts = self.term()
            if not isinstance(parts, tuple) or len(parts) != 3:
                raise FilterError("date needs a year, a month and a day")
            return dt.date(*parts)
        if v == "reldate":
            return self.relative_date()
        if v.lower() in ("none", "null"):
            return None
        raise FilterError(f"expected a value but found {v!r} in {self.text!r}")

    def relative_date(self) -> RelativeDate:
        self.expect("(")
        given: dict[str, Any] = {}
        while not self.accept(")"):
            key = self.take()[1]
            self.expect("=")
            given[key] = self.term()
            self.accept(",")
        if bad := set(given) - {"years", "months", "days", "align"}:
            raise FilterError(f"reldate takes years, months, days and align, not {', '.join(sorted(bad))}")
        if sum(bool(given.get(k)) for k in ("years", "months", "days")) > 1:
            raise FilterError("reldate takes only one of years, months and days")
        out = RelativeDate(**given)
        if out.align and out.align.lower() not in {*[n.lower() for n in calendar.day_name], "bom", "1st", "som", "boy", "soy"}:
            raise FilterError(f"bad alignment {out.align!r}")
        return out


def parse(text: str) -> Any:
    """The syntax tree of a filter expression."""
    p = _Parser(text)
    tree = p.either()
    if p.peek()[0] != "end":
        raise FilterError(f"unexpected {p.peek()[1]!r} in {text!r}")
    return tree


def _test(c: Column, op: str, value: Any) -> Column:
    """The condition on a non-null value."""
    if op == "in":
        return c.isin([v for v in value if v is not None])
    if op == "between":
        return (c >= value[0]) & (c < value[1])
    return {"eq": c == value, "ne": c != value, "lt": c < value, "le": c <= value, "gt": c > value, "ge": c >= value}[op]


def _as_text(c: Column, kind: T.DataType, fmt: str) -> Column:
    """The printed form of a value, which prefix operators compare."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        default = "yyyy-MM-dd" if isinstance(kind, T.DateType) else "yyyy-MM-dd HH:mm:ss"
        return F.date_format(c, fmt or default)
    return F.format_string(fmt, c) if fmt else c.cast("string")


def _prefix_test(text: Column, op: str, value: Any) -> Column:
    if op == "in":
        tests = [text.startswith(str(v).rstrip("*")) for v in value if v is not None]
        out = tests[0] if tests else F.lit(False)
        for t in tests[1:]:
            out = out | t
        return out
    if op == "between":
        raise FilterError("between does not compare prefixes")
    value = str(value)
    if op in ("eq", "ne"):
        starts = text.startswith(value)
        return starts if op == "eq" else ~starts
    return _test(F.substring(text, 1, len(value)), op, value)


def to_column(filter_: str | Any, ds: Dataset, now: Any = None) -> Column:
    """A condition that is true exactly for the rows of the filter's set (null or false for others)."""
    return _compile(parse(filter_) if isinstance(filter_, str) else filter_, ds, True, now)


def _compile(node: Any, ds: Dataset, positive: bool, now: Any) -> Column:
    if isinstance(node, Negation):
        return _compile(node.part, ds, not positive, now)
    if isinstance(node, (Both, Either)):
        parts = [_compile(p, ds, positive, now) for p in node.parts]
        conjunction = isinstance(node, Both) == positive
        out = parts[0]
        for p in parts[1:]:
            out = out & p if conjunction else out | p
        return out
    return _compare(node, ds, positive, now)


def _compare(node: Compare, ds: Dataset, positive: bool, now: Any) -> Column:
    kind, meta = ds.kind(node.column), ds.meta(node.column)
    c = F.col(f"`{node.column}`")

    def fix(v: Any) -> Any:
        v = v.resolve(now) if isinstance(v, RelativeDate) else v
        # As text, because years before 1000 need leading zeros.
        return F.lit(v.isoformat()).cast("date") if isinstance(v, dt.date) and not node.prefix else v

    value = tuple(map(fix, node.value)) if isinstance(node.value, tuple) else fix(node.value)
    if node.op == "contains" or meta.role == "searchabletext":
        if node.op != "contains" or meta.role != "searchabletext":
            raise FilterError(f"{node.op} does not apply to {node.column!r}, a {meta.role} column")
        hit = textsearch.matches(node.value, c)
        return hit if positive else ~hit
    if meta.role == "identity":
        raise FilterError(f"{node.column!r} is an identity column and cannot be filtered")
    scalar = meta.role in ("scalar", "weighting", "row_ordinal")
    if scalar and node.prefix:
        raise FilterError(f"prefix operators do not apply to {node.column!r}, a {meta.role} column")
    if meta.role in ("scalar", "weighting") and node.op in ("in", "notin"):
        raise FilterError(f"{node.op} does not apply to {node.column!r}, a {meta.role} column")
    op = node.op
    if op == "notin":
        op, positive = "in", not positive

    def inner(x: Column, of: T.DataType) -> Column:
        return _prefix_test(_as_text(x, of, meta.fmt), op, value) if node.prefix else _test(x, op, value)

    if isinstance(kind, T.ArrayType):
        # Any element may satisfy the operator; an empty or null array satisfies none.
        hit = F.coalesce(F.exists(c, lambda x: F.coalesce(inner(x, kind.elementType), F.lit(False))), F.lit(False))
        return hit if positive else ~hit
    if value is None:
        if op not in ("eq", "ne"):
            raise FilterError("null can only be compared for equality")
        return c.isNull() if (op == "eq") == positive else c.isNotNull()
    # Is null in the set? In discrete columns it sorts before every value.
    null_in = not scalar and (op in ("ne", "lt", "le") or (op == "in" and None in value))
    test = inner(c, kind)
    if op == "in" and not [v for v in value if v is not None]:
        test = F.lit(False)
    if positive:
        return test | c.isNull() if null_in else test
    return (~test) & c.isNotNull() if null_in else (~test) | c.isNull()


class Term:
    """Build a filter without text: Term("age").ge(65) & ~Term("sex").eq(1)."""

    def __init__(self, column: str) -> None:
        self.column = column

    def __getattr__(self, name: str):
        op, _, tail = name.partition("_")
        op = op.rstrip("_")
        if op not in (*SPELLINGS, "between", "contains"):
            raise AttributeError(name)

        def build(*values: Any) -> Node:
            value = values if op in ("in", "notin", "between") else values[0]
            if op == "contains":
                value = textsearch.parse(value)
            return Node(Compare(self.column, op, tail == "prefix", value))

        return build


@dataclass(frozen=True)
class Node:
    tree: Any

    def __and__(self, other: Node) -> Node:
        return Node(Both((self.tree, other.tree)))

    def __or__(self, other: Node) -> Node:
        return Node(Either((self.tree, other.tree)))

    def __invert__(self) -> Node:
        return Node(Negation(self.tree))

    def text(self) -> str:
        return unparse(self.tree)


def unparse(node: Any) -> str:
    """The text of a syntax tree, which parses to the same tree."""
    if isinstance(node, Negation):
        return f"not ({unparse(node.part)})"
    if isinstance(node, (Both, Either)):
        return (" and " if isinstance(node, Both) else " or ").join(f"({unparse(p)})" for p in node.parts)
    symbol = SPELLINGS[node.op][0] if node.op in SPELLINGS else node.op

    def literal(v: Any) -> str:
        if isinstance(v, tuple):
            return "(" + ", ".join(map(literal, v)) + ")"
        if isinstance(v, dt.date):
            return f"date({v.year},{v.month},{v.day})"
        if isinstance(v, RelativeDate):
            return "reldate(" + ", ".join(f"{k}={x!r}" for k, x in vars(v).items() if x) + ")"
        return "null" if v is None else f"[[{textsearch.unparse(v)}]]" if node.op == "contains" else repr(v)

    return f"{node.column} {symbol}{':' if node.prefix else ''} {literal(node.value)}"
