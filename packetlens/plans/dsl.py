"""The filter language: text -> tokens -> tree -> Column.

    filter := nothing | term [("&&" | "||") filter]       nested to the right, no precedence
    term   := field cmp value | udp | tcp | icmp

``ip.addr`` and ``port`` compare either side, for every comparator. Compiled filters are ordinary
predicates, so Catalyst pushes them to the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlens.functions.ip import format_ipv4, parse_ipv4, swap32, swap32_col
from packetlens.schema import PROTOCOLS

COMPARATORS = ("==", "!=", "<", ">", "<=", ">=")
CONNECTIVES = ("&&", "||")
#: Field -> columns it compares, kind of its value, its name in canonical text.
FIELDS = {
    "frame.time": (("ts",), "time", "frame.time:"),
    "frame.len": (("length",), "int", "length"),
    "proto": (("proto",), "int", "proto"),
    "ip.src": (("src_ip",), "ip", "ip.src"),
    "ip.dst": (("dst_ip",), "ip", "ip.dst"),
    "ip.addr": (("src_ip", "dst_ip"), "ip", "ip.addr"),
    "port": (("src_port", "dst_port"), "int", "port"),
    "port.src": (("src_port",), "int", "port.src"),
    "port.dst": (("dst_port",), "int", "port.dst"),
}
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTHS = {spelling: i + 1 for i, m in enumerate(_MONTHS) for spelling in (m, m.lower())}
#: Bits a literal of the field keeps in compatibility mode.
NARROW = {"frame.len": 16, "proto": 8, "port": 16, "port.src": 16, "port.dst": 16}
#: Changes of connective in a filter beyond which it compiles to a CASE.
MANY_CHANGES = 64
_TOKEN = re.compile(r"&&|\|\||[=!<>~]+|[^\s&|=!<>~]+|[&|]")


class FilterSyntaxError(ValueError):
    def __init__(self, message: str, position: int, choices: tuple[str, ...] = ()):
        self.position, self.choices = position, choices
        super().__init__(f"{message} at position {position}" + (f"; one of: {', '.join(choices)}" if choices else ""))


@dataclass(frozen=True)
class Term:
    field: str
    op: str
    value: int  # number, address, or epoch microseconds

    def canonical(self) -> str:
        _, kind, name = FIELDS[self.field]
        shown = format_ipv4(self.value) if kind == "ip" else f"{self.value // 1_000_000} {self.value % 1_000_000}" if kind == "time" else str(self.value)
        return f"{name} {self.op} {shown}"


@dataclass(frozen=True)
class And:
    parts: tuple

    def canonical(self) -> str:
        return _canonical(self)


@dataclass(frozen=True)
class Or:
    parts: tuple

    def canonical(self) -> str:
        return _canonical(self)


def chain(node: Node) -> tuple[list[Term], list[type]]:
    """The terms of a tree and the connectives between them: filters nest to the right, so a tree is a chain, however long."""
    terms, kinds = [], []
    while not isinstance(node, Term):
        if len(node.parts) == 1:
            node = node.parts[0]
            continue
        terms.append(node.parts[0])
        kinds.append(type(node))
        node = node.parts[1]
    return [*terms, node], kinds


def _canonical(node: Node) -> str:
    if not node.parts:
        return "()"
    terms, kinds = chain(node)
    words = {And: " and ", Or: " or "}
    inner = "".join(f"({t.canonical()}{words[k]}" for t, k in zip(terms, kinds, strict=False)) + terms[-1].canonical() + ")" * len(kinds)
    return f"({inner})" if len(node.parts) == 1 else inner


Node = Term | And | Or


class _Parser:
    def __init__(self, text: str, zone: str):
        self.tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(text)]
        self.end, self.at, self.zone = len(text), 0, zone

    def next(self, what: str, choices: tuple[str, ...] = ()) -> tuple[str, int]:
        if self.at >= len(self.tokens):
            raise FilterSyntaxError(f"missing {what}", self.end, choices)
        self.at += 1
        return self.tokens[self.at - 1]

    def filter(self) -> Node:
        terms, kinds = [self.term()], []
        while self.at < len(self.tokens):
            token, position = self.next("connective")
            if token not in CONNECTIVES:
                raise FilterSyntaxError(f"unknown connective {token!r}", position, CONNECTIVES)
            kinds.append(And if token == "&&" else Or)
            terms.append(self.term())
        node = terms.pop()
        while terms:
            node = kinds.pop()((terms.pop(), node))
        return node

    def term(self) -> Term:
        names = (*FIELDS, *PROTOCOLS)
        field, position = self.next("field", names)
        if field.lower() in PROTOCOLS:
            return Term("proto", "==", PROTOCOLS[field.lower()])
        if field not in FIELDS:
            raise FilterSyntaxError(f"unknown field {field!r}", position, names)
        op, position = self.next("comparator", COMPARATORS)
        if op not in COMPARATORS:
            raise FilterSyntaxError(f"unknown comparator {op!r}", position, COMPARATORS)
        kind = FIELDS[field][1]
        value, position = self.next("value")
        try:
            if kind == "ip":
                return Term(field, op, parse_ipv4(value))
            if kind == "int":
                if not (value.isascii() and value.isdigit()):
                    raise ValueError(f"not a number: {value!r}")
                if len(value.lstrip("0")) > 18:
                    raise ValueError(f"number with more than 18 digits: {value!r}")
                return Term(field, op, int(value))
            return Term(field, op, self.time(value, position))
        except ValueError as e:
            if isinstance(e, FilterSyntaxError):
                raise
            raise FilterSyntaxError(str(e), position) from None

    def time(self, month: str, position: int) -> int:
        if month not in MONTHS:
            raise FilterSyntaxError(f"unknown month {month!r}", position, _MONTHS)
        day, year, clock = (self.next("part of a time (Mon D, YYYY HH:MM:SS)")[0] for _ in range(3))
        when = datetime.strptime(f"{MONTHS[month]} {day} {year} {clock}", "%m %d, %Y %H:%M:%S")
        return int(when.replace(tzinfo=ZoneInfo(self.zone)).timestamp()) * 1_000_000


def parse(text: str, zone: str = "UTC") -> And:
    """The tree of a filter; its root is always a conjunction, empty for an empty filter."""
    p = _Parser(text, zone)
    return And((p.filter(),) if p.tokens else ())


def _compare(left: Column, op: str, right) -> Column:
    return {"==": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]


def _moment(us: int) -> Column:
    return F.lit(datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us))


def compile_filter(node: Node, compat: bool = False) -> Column:
    """A Column over the packet schema.

    ``compat`` reproduces three observable oddities: address ``< > <= >=`` on byte-swapped numbers, literals cut to
    their field's width, and ``frame.time >`` / ``<=`` that work by whole seconds.
    """
    if not isinstance(node, Term):
        return _compile_chain(*chain(node), compat) if node.parts else F.lit(True)
    columns, kind, _ = FIELDS[node.field]
    value, op = node.value, node.op
    if kind == "time":
        if compat and op == ">":
            return F.col("ts") >= _moment(value)
        if compat and op == "<=":
            return F.col("ts") < _moment(value + 1_000_000)
        return _compare(F.col("ts"), op, _moment(value))
    if compat and node.field in NARROW:
        value &= (1 << NARROW[node.field]) - 1
    swapped = compat and kind == "ip" and op not in ("==", "!=")
    sides = [_compare(swap32_col(F.col(c)) if swapped else F.col(c), op, F.lit(swap32(value) if swapped else value)) for c in columns]
    return reduce(lambda a, b: a | b, sides)


def balanced(parts: list[Column], kind: type) -> Column:
    """All parts connected, as a tree of small depth."""
    while len(parts) > 1:
        parts = [reduce(lambda a, b: a & b if kind is And else a | b, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def _compile_chain(terms: list[Term], kinds: list[type], compat: bool) -> Column:
    """Runs of one connective become balanced trees; with many changes of connective, one flat CASE decides term by term."""
    columns = [compile_filter(t, compat) for t in terms]
    if sum(a is not b for a, b in zip(kinds, kinds[1:], strict=False)) > MANY_CHANGES:
        case = F
        for column, kind in zip(columns, kinds, strict=False):
            known = F.coalesce(column, F.lit(False))
            case = case.when(~known, False) if kind is And else case.when(known, True)
        return case.otherwise(columns[-1])
    out, at = columns[-1], len(kinds)
    while at:
        start = at - 1
        while start and kinds[start - 1] is kinds[at - 1]:
            start -= 1
        out, at = balanced([*columns[start:at], out], kinds[at - 1]), start
    return out


# --- what a filter implies ----------------------------------------------------------------

#: Epoch microseconds before and after all times.
FIRST, LAST = -(2**63), 2**63 - 1
Interval = tuple[int, int]
ALWAYS: list[Interval] = [(FIRST, LAST)]
#: Intervals that a predicate on partitions or files tests; a filter with more tests the hulls of neighbours.
MOST_INTERVALS = 64


def union(a: list[Interval], b: list[Interval]) -> list[Interval]:
    """Sorted disjoint closed intervals that cover both; neighbours without a microsecond between are one."""
    out: list[Interval] = []
    for low, high in sorted([*a, *b]):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def intersection(a: list[Interval], b: list[Interval]) -> list[Interval]:
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        low, high = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if low <= high:
            out.append((low, high))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return out


def fewer(intervals: list[Interval], most: int = MOST_INTERVALS) -> list[Interval]:
    """At most ``most`` intervals that cover these: the smallest gaps are closed."""
    if len(intervals) <= most:
        return intervals
    gaps = sorted(range(1, len(intervals)), key=lambda i: intervals[i][0] - intervals[i - 1][1], reverse=True)
    starts = [0, *sorted(gaps[: most - 1]), len(intervals)]
    return [(intervals[a][0], intervals[b - 1][1]) for a, b in zip(starts, starts[1:], strict=False)]


def _fold(node: Node, of_term, both, either):
    """A value of a tree from those of its terms, for chains of any length."""
    if isinstance(node, Term):
        return of_term(node)
    terms, kinds = chain(node)
    out = of_term(terms.pop())
    while terms:
        out = (both if kinds.pop() is And else either)(of_term(terms.pop()), out)
    return out


def time_intervals(node: Node) -> list[Interval]:
    """The times, as sorted disjoint closed intervals of epoch microseconds, outside which nothing can match.

    Exact for what a filter says of whole comparisons; a term without time allows all. Sound for both modes.
    """
    if not isinstance(node, Term) and not node.parts:
        return ALWAYS
    return _fold(node, _term_intervals, intersection, union)


def _term_intervals(term: Term) -> list[Interval]:
    if FIELDS[term.field][1] != "time" or term.op == "!=":
        return ALWAYS
    second = term.value + 999_999
    return [{"==": (term.value, term.value), "<": (FIRST, term.value), "<=": (FIRST, second), ">": (term.value, LAST), ">=": (term.value, LAST)}[term.op]]


def host_sets(node: Node) -> list[frozenset[int]]:
    """Sets of addresses: a matching packet has one of each set at one of its ends. Empty if the filter asks for none."""

    def of_term(term: Term) -> list[frozenset[int]]:
        return [frozenset([term.value])] if FIELDS[term.field][1] == "ip" and term.op == "==" else []

    def either(a: list, b: list) -> list:
        # one set from each side, the smallest, is enough to be sound
        return [min(a, key=len) | min(b, key=len)] if a and b else []

    if not isinstance(node, Term) and not node.parts:
        return []
    return list(dict.fromkeys(_fold(node, of_term, lambda a, b: [*a, *b], either)))


def time_range(node: Node) -> tuple[int | None, int | None] | None:
    """The hull of ``time_intervals`` (None: open end); None: nothing matches."""
    found = time_intervals(node)
    if not found:
        return None
    low, high = found[0][0], found[-1][1]
    return (None if low == FIRST else low, None if high == LAST else high)


def date_predicate(node: Node, column: str = "ts_date") -> Column | None:
    """The intervals as a predicate on a UTC date partition column, or None if they say nothing."""
    found = time_intervals(node)
    if found == ALWAYS:
        return None
    if not found:
        return F.lit(False)
    day = lambda us: us if us in (FIRST, LAST) else us // 86_400_000_000
    days = fewer(union([(day(a), day(b)) for a, b in found], []))
    if days == ALWAYS:
        return None

    def test(low: int, high: int) -> Column:
        moment = lambda d: F.lit(date(1970, 1, 1) + timedelta(days=d))
        ends = ([F.col(column) >= moment(low)] if low != FIRST else []) + ([F.col(column) <= moment(high)] if high != LAST else [])
        return reduce(lambda a, b: a & b, ends)

    return balanced([test(*d) for d in days], Or)
