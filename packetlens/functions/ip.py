"""IPv4 addresses as numbers and as text; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ipv4(text: str) -> int:
    """``a.b.c.d`` as a network-order number; ValueError if it is none."""
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isascii() and p.isdigit() and int(p) < 256 for p in parts):
        raise ValueError(f"not an IPv4 address: {text!r}")
    return int.from_bytes(bytes(map(int, parts)), "big")


def format_ipv4(value: int) -> str:
    return ".".join(map(str, value.to_bytes(4, "big")))


def swap32(value: int) -> int:
    return int.from_bytes(value.to_bytes(4, "big"), "little")


def ip_to_long(col: Column) -> Column:
    """Dotted text to number; null if a part is missing or no byte."""
    parts = F.split(col, r"\.")
    octets = [F.try_element_at(parts, F.lit(i + 1)).try_cast("int") for i in range(4)]
    valid = (F.size(parts) == 4) & octets[0].between(0, 255) & octets[1].between(0, 255) & octets[2].between(0, 255) & octets[3].between(0, 255)
    total = sum((o.cast("long") * 256 ** (3 - i) for i, o in enumerate(octets)), F.lit(0).cast("long"))
    return F.when(valid, total)


def long_to_ip(col: Column) -> Column:
    byte = lambda n: F.shiftright(col, n).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def swap32_col(col: Column) -> Column:
    """The number whose bytes are those of ``col`` reversed."""
    c = col.cast("long")
    byte = lambda n: F.shiftright(c, n).bitwiseAND(F.lit(255).cast("long"))
    return byte(24) + F.shiftleft(byte(16), 8) + F.shiftleft(byte(8), 16) + F.shiftleft(byte(0), 24)


def endpoint(ip: Column, port: Column, proto: Column) -> Column:
    """``address : port`` for TCP and UDP, else the address."""
    return F.when(proto.isin(6, 17), F.concat(long_to_ip(ip), F.lit(" : "), port.cast("string"))).otherwise(long_to_ip(ip))


def packet_text(src_ip: str = "src_ip", dst_ip: str = "dst_ip", src_port: str = "src_port", dst_port: str = "dst_port", proto: str = "proto", length: str = "length", ts: str = "ts") -> Column:
    """One line of text for a packet."""
    us = F.unix_micros(ts)
    return F.concat_ws(
        " ",
        endpoint(F.col(src_ip), F.col(src_port), F.col(proto)),
        F.lit("->"),
        endpoint(F.col(dst_ip), F.col(dst_port), F.col(proto)),
        F.format_string("proto=%d length=%d time=%d.%06d", F.col(proto), F.col(length), F.expr(f"unix_micros({ts}) div 1000000"), us % 1000000),
    )
