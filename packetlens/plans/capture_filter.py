"""Capture filters in the widely used pcap-filter syntax, as far as the packet table can answer them: text -> Column.

    filter    := operand (("and" | "&&" | "or" | "||") operand)*      both bind alike, from the left
    operand   := ("not" | "!") operand | "(" filter ")" | primitive
    primitive := [ip | tcp | udp | icmp] [src | dst | src or dst | src and dst] [host | net | port | portrange] value
               | ip | tcp | udp | icmp | [ip] proto number or name | less number | greater number

A value without qualifiers takes those of the primitive before it (``port 80 or 443``). Nets are ``a.b.c.d/bits``,
``a.b.c.d mask m.m.m.m`` or leading parts (``10.1``). Ports are those of TCP and UDP packets.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlens.functions.ip import parse_ipv4
from packetlens.plans.dsl import FilterSyntaxError
from packetlens.schema import PROTOCOLS, TCP, UDP

_TOKEN = re.compile(r"&&|\|\||[()!]|[^\s()!&|]+")
_AND, _OR, _NOT = ("and", "&&"), ("or", "||"), ("not", "!")
_TYPES, _SIDES = ("host", "net", "port", "portrange"), ("src", "dst")
_COLUMNS = {"host": ("src_ip", "dst_ip"), "net": ("src_ip", "dst_ip"), "port": ("src_port", "dst_port"), "portrange": ("src_port", "dst_port")}


class _Parser:
    def __init__(self, text: str):
        self.tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(text)]
        self.at, self.end = 0, len(text)
        self.last: tuple[str | None, str, str] | None = None

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def fail(self, what: str):
        position = self.tokens[self.at][1] if self.at < len(self.tokens) else self.end
        raise FilterSyntaxError(what, position)

    def take(self, what: str) -> str:
        if self.at >= len(self.tokens):
            self.fail(f"missing {what}")
        self.at += 1
        return self.tokens[self.at - 1][0]

    def filter(self) -> Column:
        out = self.operand()
        while self.peek() in (*_AND, *_OR):
            both = self.take("connective") in _AND
            right = self.operand()
            out = out & right if both else out | right
        return out

    def operand(self) -> Column:
        negations = 0
        while self.peek() in _NOT:
            self.at += 1
            negations += 1
        if self.peek() == "(":
            self.at += 1
            out = self.filter()
            if self.peek() != ")":
                self.fail("missing )")
            self.at += 1
        else:
            out = self.primitive()
        return ~out if negations % 2 else out

    def number(self, what: str, most: int) -> int:
        token = self.take(what)
        if not (token.isascii() and token.isdigit() and int(token) <= most):
            self.at -= 1
            self.fail(f"{what} expected, not {token!r}")
        return int(token)

    def primitive(self) -> Column:
        first = self.peek()
        if first in ("less", "greater"):
            self.at += 1
            n = self.number("length", 2**31 - 1)
            return F.col("length") <= n if first == "less" else F.col("length") >= n
        protocol = None
        if first == "ip" or first in PROTOCOLS:
            protocol = self.take("protocol")
        if self.peek() == "proto" and protocol in (None, "ip"):
            self.at += 1
            name = self.peek().lstrip("\\")
            if name in PROTOCOLS:
                self.at += 1
                return F.col("proto") == PROTOCOLS[name]
            return F.col("proto") == self.number("protocol", 255)
        side = self.sides()
        kind = self.take("type") if self.peek() in _TYPES else None
        if side is None and kind is None:
            if protocol is not None:
                return F.lit(True) if protocol == "ip" else F.col("proto") == PROTOCOLS[protocol]
            if self.last is None or not self.peek():
                self.fail("primitive expected")
            protocol, side, kind = self.last
        self.last = (protocol, side or "or", kind or "host")
        return self.value(*self.last)

    def sides(self) -> str | None:
        """src, dst, "or" (either) or "and" (both); None if not said."""
        if self.peek() not in _SIDES:
            return None
        side = self.take("side")
        if self.peek() in ("or", "and") and self.peek(1) in _SIDES and self.peek(1) != side:
            side = self.take("connective")
            self.at += 1
        return side

    def value(self, protocol: str | None, side: str, kind: str) -> Column:
        low, high = self.bounds(kind)
        ends = [F.col(c) == low if low == high else F.col(c).between(low, high) for c in _COLUMNS[kind]]
        out = {"src": ends[0], "dst": ends[1], "or": ends[0] | ends[1], "and": ends[0] & ends[1]}[side]
        if protocol in PROTOCOLS:
            return out & (F.col("proto") == PROTOCOLS[protocol])
        return out & F.col("proto").isin(TCP, UDP) if kind.startswith("port") else out

    def bounds(self, kind: str) -> tuple[int, int]:
        if kind == "port":
            n = self.number("port", 65535)
            return n, n
        token = self.take("value")
        try:
            if kind == "portrange":
                low, high = (int(x) for x in token.split("-"))
                if not 0 <= low <= high <= 65535:
                    raise ValueError(f"not a range of ports: {token!r}")
                return low, high
            if kind == "host":
                return (parse_ipv4(token),) * 2
            address, _, bits = token.partition("/")
            parts = address.split(".")
            start = parse_ipv4(".".join(parts + ["0"] * (4 - len(parts))))
            if self.peek() == "mask" and not bits:
                self.at += 1
                mask = parse_ipv4(self.take("mask"))
                size = 2**32 - mask
                if size & (size - 1):
                    raise ValueError("mask with holes")
            else:
                size = 1 << (32 - (int(bits) if bits else 8 * len(parts)))
            if start % size:
                raise ValueError(f"bits beyond the net's: {token!r}")
            return start, start + size - 1
        except ValueError as e:
            self.at -= 1
            self.fail(str(e))


def compile_capture_filter(text: str) -> Column:
    """A Column over the packet schema; an empty text passes everything. FilterSyntaxError names a position."""
    p = _Parser(text)
    if not p.tokens:
        return F.lit(True)
    out = p.filter()
    if p.at < len(p.tokens):
        p.fail("connective expected")
    return out
