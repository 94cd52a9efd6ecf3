"""The headers of captured frames, side by side: where each protocol begins, and the bytes there."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from packetlens.schema import ICMP, TCP, UDP

ETHERNET, NULL, LOOP, RAW, SLL, SLL2 = 1, 0, 108, (12, 14, 101, 228), 113, 276
VLAN_TYPES = (0x8100, 0x88A8, 0x9100)
IPV4, IPV6, ARP = 0x0800, 0x86DD, 0x0806
ICMP6 = 58
#: Address families of loopback frames, in either byte order (fixed values).
FAMILIES = {IPV4: (2, 0x02000000), IPV6: (10, 24, 28, 30, 0x0A000000, 0x18000000, 0x1C000000, 0x1E000000)}
#: Extension headers of IPv6 that are stepped over: hop by hop, routing, destination.
EXTENSIONS, FRAGMENT = (0, 43, 60), 44
MOST_TAGS = 3


class Frames:
    """Frames whose data begin at ``off`` in ``buf`` and have ``captured`` bytes. Offsets are -1 where a frame has no such header.

    Protocols are found behind up to three VLAN tags.
    """

    def __init__(self, buf: memoryview, off: np.ndarray, captured: np.ndarray, original: np.ndarray, link: np.ndarray):
        self.raw = np.concatenate([np.frombuffer(buf, np.uint8), np.zeros(64, np.uint8)])
        self.off, self.end, self.original, self.link = off, off + captured, original, link
        self._link_layer()

    def __len__(self) -> int:
        return len(self.off)

    def byte(self, at: np.ndarray) -> np.ndarray:
        return self.raw[np.minimum(at, len(self.raw) - 1)].astype(np.int64)

    def short(self, at: np.ndarray) -> np.ndarray:
        return self.byte(at) << 8 | self.byte(at + 1)

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.short(at) << 16 | self.short(at + 2)

    def _link_layer(self) -> None:
        off, end, link = self.off, self.end, self.link
        none = np.zeros(len(off), np.int64)
        is_raw, self.is_ethernet = np.isin(link, RAW), link == ETHERNET
        self.tags, self.vlan_id = none, np.full((MOST_TAGS, len(off)), -1, np.int64)
        version = self.byte(off) >> 4
        kind = np.where(is_raw, np.where(version == 6, IPV6, IPV4), 0)
        body = np.where(is_raw, off, -1)
        if not is_raw.all():
            # the type field, behind the tags
            at = off + 12
            for i in range(MOST_TAGS):
                tagged = self.is_ethernet & np.isin(self.short(at), VLAN_TYPES) & (at + 4 <= end)
                if not tagged.any():
                    break
                self.vlan_id[i] = np.where(tagged, self.short(at + 2) & 0xFFF, -1)
                self.tags = self.tags + tagged
                at = np.where(tagged, at + 4, at)
            kind, body = np.where(self.is_ethernet, self.short(at), kind), np.where(self.is_ethernet, at + 2, body)
            for cooked, where, after in ((SLL, 14, 16), (SLL2, 0, 20)):
                if (here := link == cooked).any():
                    kind, body = np.where(here, self.short(off + where), kind), np.where(here, off + after, body)
            if (here := (link == NULL) | (link == LOOP)).any():
                family = self.word(off)
                four, six = np.isin(family, FAMILIES[IPV4]), np.isin(family, FAMILIES[IPV6])
                kind, body = np.where(here, np.where(four, IPV4, np.where(six, IPV6, 0)), kind), np.where(here, off + 4, body)
        self.ethertype, self.payload = kind, body
        ip = np.where(kind == IPV4, body, -1)
        self.ip = np.where((ip >= 0) & (ip + 20 <= end) & (self.byte(ip) >> 4 == 4), ip, -1)
        self.ip6_any = (kind == IPV6) & (is_raw | self.is_ethernet)

    @cached_property
    def ip6(self) -> np.ndarray:
        ip6 = np.where(self.ethertype == IPV6, self.payload, -1)
        return np.where((ip6 >= 0) & (ip6 + 40 <= self.end) & (self.byte(ip6) >> 4 == 6), ip6, -1)

    @cached_property
    def proto(self) -> np.ndarray:
        """The protocol that IPv4 or IPv6 carries; -1 without either."""
        return self._transport[0]

    @cached_property
    def body(self) -> np.ndarray:
        """Where the transport header begins; -1 without one, as in later fragments."""
        return self._transport[1]

    @cached_property
    def _transport(self) -> tuple[np.ndarray, np.ndarray]:
        four = self.ip >= 0
        size = (self.byte(self.ip) & 15) * 4
        proto = np.where(four, self.byte(self.ip + 9), -1)
        body = np.where(four & (size >= 20) & (self.short(self.ip + 6) & 0x1FFF == 0), self.ip + size, -1)
        if (self.ethertype == IPV6).any():
            six = self.ip6 >= 0
            proto, at = np.where(six, self.byte(self.ip6 + 6), proto), np.where(six, self.ip6 + 40, -1)
            for _ in range(4):
                more = six & np.isin(proto, EXTENSIONS) & (at + 8 <= self.end)
                proto, at = np.where(more, self.byte(at), proto), np.where(more, at + 8 + 8 * self.byte(at + 1), at)
            # behind a fragment header only the first fragment has what follows
            fragment = six & (proto == FRAGMENT) & (at + 8 <= self.end)
            first = self.short(at + 2) >> 3 == 0
            proto, at = np.where(fragment, self.byte(at), proto), np.where(fragment, np.where(first, at + 8, -1), at)
            body = np.where(six, at, body)
        return proto, np.where(body <= self.end, body, -1)

    def start(self, name: str) -> np.ndarray:
        """Where a protocol's header begins, by its name in filters; -1 where a frame has none."""
        if name in ("ether", "link"):
            return np.where(self.is_ethernet, self.off, -1) if name == "ether" else self.off
        if name in ("ip", "ip6"):
            return self.ip if name == "ip" else self.ip6
        if name == "arp":
            return np.where(self.ethertype == ARP, self.payload, -1)
        number = {"tcp": TCP, "udp": UDP, "icmp": ICMP, "icmp6": ICMP6}[name]
        return np.where(self.proto == number, self.body, -1)
