"""Capture files to packet columns: classic pcap and pcapng, vectorised with numpy.

Only record offsets are found one by one; headers of the packets of a piece of a file are then read side by side. IPv4 TCP, UDP and
ICMP packets become rows; everything else is counted and dropped. A record needs 4 bytes of its TCP or UDP header
for the ports; ICMP has ports 0. Fragments after the first have no transport header and are dropped. Truncated
files give the whole records they have.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field

import numpy as np

from packetlens.schema import ICMP, TCP, UDP
from packetlens.sources.frames import Frames

CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
PCAPNG = b"\x0a\x0d\x0d\x0a"


class CaptureError(ValueError):
    pass


@dataclass
class Packets:
    """Columns of the kept packets, and counts of what was seen."""

    src_ip: np.ndarray
    dst_ip: np.ndarray
    src_port: np.ndarray
    dst_port: np.ndarray
    proto: np.ndarray
    length: np.ndarray
    ts_us: np.ndarray
    seen: Counter = field(default_factory=Counter)

    def __len__(self) -> int:
        return len(self.src_ip)


def _classic(buf: memoryview, order: str, per_us: int, link: int, at: int = 24, stop: int | None = None) -> tuple[np.ndarray, ...]:
    """Columns of the whole records that begin at ``at`` or later and before ``stop``; the last item is where the next one begins."""
    head = struct.Struct(order + "I").unpack_from
    end, offsets = len(buf), []
    stop = end if stop is None else stop
    while at < stop and at + 16 <= end:
        size = head(buf, at + 8)[0]
        if at + 16 + size > end:
            break
        offsets.append(at)
        at += 16 + size
    off = np.array(offsets, np.int64)
    raw = np.frombuffer(buf, np.uint8)
    words = raw[off[:, None] + np.arange(16)].view(np.dtype(order + "u4")).astype(np.int64) if len(off) else np.empty((0, 4), np.int64)
    # per_us is 1000 for microsecond files: sub-second units are microseconds already
    us = words[:, 0] * 1_000_000 + (words[:, 1] if per_us == 1000 else words[:, 1] // 1000)
    return off + 16, words[:, 2], words[:, 3], us, np.full(len(off), link), at


def _link(header: bytes | memoryview, order: str) -> int:
    return struct.unpack_from(order + "I", header, 20)[0] & 0x0FFFFFFF


@dataclass
class Tables:
    """What a pcapng reader has to know before a block: byte order, and link type and time unit of each interface of the section."""

    order: str = "<"
    links: list[int] = field(default_factory=list)
    units: list[int] = field(default_factory=list)

    def section(self, mark: bytes) -> None:
        self.order, self.links, self.units = ("<" if mark == LITTLE else ">"), [], []

    def interface(self, link: int, unit: int) -> None:
        self.links.append(link)
        self.units.append(unit)


LITTLE, BIG = b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"
#: Kinds of block: section, interface, packet (obsolete), simple packet, enhanced packet.
SECTION, INTERFACE, PACKET, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 2, 3, 6


def _unit(buf: memoryview, order: str, at: int, end: int) -> int:
    """Units a second of an interface, from the options of its block."""
    while at + 4 <= end:
        code, n = struct.unpack_from(order + "HH", buf, at)
        if code == 0:
            break
        if code == 9:
            return 2 ** (buf[at + 4] & 0x7F) if buf[at + 4] & 0x80 else 10 ** buf[at + 4]
        at += 4 + (n + 3) // 4 * 4
    return 10**6


def _pcapng(buf: memoryview, tables: Tables | None = None, at: int = 0, stop: int | None = None, found: list | None = None) -> tuple:
    """Records of the blocks that begin at ``at`` or later and before ``stop``; the last item is where the next block begins.

    ``found`` gets the sections and interfaces instead, and no packet is read.
    """
    rows, tables = [], tables or Tables()
    stop = len(buf) if stop is None else stop
    while at < stop and at + 12 <= len(buf):
        if bytes(buf[at : at + 4]) == PCAPNG:
            mark = bytes(buf[at + 8 : at + 12])
            tables.section(mark)
            if found is not None:
                found.append((at, "section", int(mark == LITTLE), 0))
        kind, size = struct.unpack_from(tables.order + "II", buf, at)
        if size < 12 or at + size > len(buf):
            break
        if kind == INTERFACE:
            link, unit = struct.unpack_from(tables.order + "H", buf, at + 8)[0], _unit(buf, tables.order, at + 16, at + size - 4)
            tables.interface(link, unit)
            if found is not None:
                found.append((at, "interface", link, unit))
        elif found is not None:
            pass
        elif kind in (PACKET, ENHANCED) and size >= 32:
            where, high, low, captured, original = struct.unpack_from(tables.order + ("IIIII" if kind == ENHANCED else "HxxIIII"), buf, at + 8)
            if where < len(tables.links) and captured <= size - 32:
                rows.append((at + 28, captured, original, ((high << 32) | low) * 10**6 // tables.units[where], tables.links[where]))
        elif kind == SIMPLE and tables.links:
            original = struct.unpack_from(tables.order + "I", buf, at + 8)[0]
            rows.append((at + 12, min(original, size - 16), original, 0, tables.links[0]))
        at += size
    table = np.array(rows, np.int64).reshape(-1, 5)
    return *(table[:, i] for i in range(5)), at


#: A test of frames: which of them to keep.
Keep = Callable[[Frames], np.ndarray]
#: The bytes of a file from an offset on, so many or what is left.
Load = Callable[[int, int], bytes]
#: Bytes of a file that are decoded at once. A task holds one piece, however long its file or part; a record that is longer is read whole.
PIECE = 4 << 20


def _pieces(load: Load, size: int, at: int, stop: int, cut: Callable[[memoryview, int], tuple], first: Callable[[memoryview], int], piece: int | None = None) -> Generator[tuple, None, int]:
    """Buffer and records of one piece of a file of ``size`` bytes after another, of the records that begin at ``at`` or later and before ``stop``; returns where the next one begins.

    ``cut`` gives a buffer's whole records and where the next one begins, ``first`` the length of a buffer's first record (0: it has none).
    """
    want = piece or PIECE
    while at < stop:
        buf = memoryview(load(at, want))
        *records, end = cut(buf, min(stop - at, len(buf)))
        if end:
            at, want = at + end, piece or PIECE
            yield buf, *records
        elif len(buf) < (want := first(buf)) <= size - at:
            continue
        else:
            break
    return at


def _classic_pieces(load: Load, size: int, header: bytes, at: int, stop: int, piece: int | None = None) -> Generator[tuple, None, int]:
    order, per_us = CLASSIC[header[:4]]
    link = _link(header, order)
    return _pieces(load, size, at, stop, lambda buf, end: _classic(buf, order, per_us, link, 0, end), lambda buf: 16 + struct.unpack_from(order + "I", buf, 8)[0] if len(buf) >= 16 else 0, piece)


def _pcapng_pieces(load: Load, size: int, tables: Tables, at: int, stop: int, piece: int | None = None) -> Generator[tuple, None, int]:
    return _pieces(load, size, at, stop, lambda buf, end: _pcapng(buf, tables, 0, end), lambda buf: struct.unpack_from(tables.order + "I", buf, 4)[0] if len(buf) >= 12 else 0, piece)


def capture_pieces(load: Load, size: int, piece: int | None = None) -> Iterator[tuple]:
    """Buffer, offsets, captured and original lengths, times and link types of a whole capture file, piece by piece; what is none is an error at once."""
    head = bytes(load(0, 24))
    if head[:4] in CLASSIC:
        if len(head) < 24:
            raise CaptureError("file header is cut off")
        return _classic_pieces(load, size, head, 24, size, piece)
    if head[:4] == PCAPNG:
        return _pcapng_pieces(load, size, Tables(), 0, size, piece)
    raise CaptureError("neither pcap nor pcapng")


def loaded(data: bytes | memoryview) -> tuple[Load, int]:
    """Bytes in memory as a file."""
    return lambda at, n: bytes(data[at : at + n]), len(data)


NOTHING = (memoryview(b""), *[np.empty(0, np.int64)] * 5)


def _records(data: bytes) -> tuple:
    """The records of a whole capture in memory, as one piece."""
    return next(capture_pieces(*loaded(data), max(1, len(data))), NOTHING)


def read_packets(data: bytes, keep: Keep | None = None) -> Packets:
    """The packets of a small capture whose frames pass ``keep``."""
    return _decoded(*_records(data), keep)


@dataclass
class RawFrames:
    """Frames as they were captured."""

    ts_us: np.ndarray
    length: np.ndarray
    link: np.ndarray
    data: list[bytes]


def read_frames(data: bytes, keep: Keep | None = None) -> RawFrames:
    return _raw(*_records(data), keep)


def _raw(buf: memoryview, off: np.ndarray, captured: np.ndarray, original: np.ndarray, us: np.ndarray, link: np.ndarray, keep: Keep | None = None) -> RawFrames:
    some = np.arange(len(off)) if keep is None else np.flatnonzero(keep(Frames(buf, off, captured, original, link)))
    return RawFrames(us[some], original[some], link[some], [bytes(buf[a : a + n]) for a, n in zip(off[some].tolist(), captured[some].tolist(), strict=True)])


def can_split(header: bytes) -> bool:
    return len(header) == 24 and header[:4] in CLASSIC


#: Bytes behind a split that its task reads too, and records in a row that must look right where a split begins.
OVERLAP, IN_A_ROW = 4 << 20, 32
_YEAR = 366 * 86_400


def first_record(header: bytes, seconds: int, data: memoryview, to_end: bool) -> int:
    """Where the first record at or after the start of ``data`` begins: the first place with records in a row that look right.

    ``seconds`` is the time of the file's first record, ``to_end`` says that ``data`` reaches the file's end. It is a guess
    that the reader of the split before checks: it gets there record by record.
    """
    order, per_us = CLASSIC[header[:4]]
    longest = max(struct.unpack_from(order + "I", header, 16)[0], 65_535)
    fields = struct.Struct(order + "IIII").unpack_from
    limit = 1_000_000 if per_us == 1000 else 1_000_000_000

    def looks_right(at: int) -> bool:
        for _ in range(IN_A_ROW):
            if at + 16 > len(data):
                return to_end
            sec, part, captured, original = fields(data, at)
            if part >= limit or captured > longest or captured > original or abs(sec - seconds) > _YEAR:
                return False
            at += 16 + captured
        return True

    raw = np.frombuffer(data[: OVERLAP + 16], np.uint8)
    for start in range(0, max(0, len(raw) - 15), 1 << 16):
        part = raw[start : start + (1 << 16) + 15]
        words = np.stack([part[i : len(part) - 15 + i] for i in range(4, 12)], 1).copy().view(np.dtype(order + "u4"))
        for at in np.flatnonzero((words[:, 0] < limit) & (words[:, 1] <= longest)):
            if looks_right(start + int(at)):
                return start + int(at)
    if to_end:
        return len(data)
    raise CaptureError("no record found where a split begins; read the file whole with splitbytes=0")


def classic_part(load: Load, size: int, start: int, stop: int) -> Iterator[tuple]:
    """The records that begin in bytes [start, stop) of a capture of ``size`` bytes, piece by piece; an error at the end if the next part does not begin where they end."""
    head = bytes(load(0, 40))
    seconds = int.from_bytes(head[24:28], "little" if CLASSIC[head[:4]][0] == "<" else "big")

    def first(at: int) -> int:
        data = memoryview(load(at, OVERLAP))
        return at + first_record(head[:24], seconds, data, at + len(data) >= size)

    end = yield from _classic_pieces(load, size, head[:24], start if start == 24 else first(start), stop)
    if stop < size and end != first(stop):
        raise CaptureError(APART)


APART = "a split does not begin where the one before ends; read the file whole with splitbytes=0"
#: Blocks in a row whose lengths fore and aft agree where a pcapng split begins, and the longest block.
BLOCKS_IN_A_ROW, LONGEST_BLOCK, ALL = 16, 1 << 24, 1 << 30


def first_block(data: memoryview, to_end: bool) -> int:
    """Where the first block at or after the start of ``data`` begins, in either byte order: lengths stand at both ends of a block, so a row of blocks is unmistakable."""

    def blocks(at: int, order: str) -> int:
        """How many blocks in a row begin at ``at``, ALL for a full row or one that ends where the file does; 0 if one is none."""
        read, n = struct.Struct(order + "I").unpack_from, 0
        while n < BLOCKS_IN_A_ROW:
            if at == len(data) and to_end:
                return ALL
            if at + 8 > len(data):
                return n if to_end else 0
            if bytes(data[at : at + 4]) == PCAPNG and at + 12 <= len(data):
                order = "<" if bytes(data[at + 8 : at + 12]) == LITTLE else ">"
                read = struct.Struct(order + "I").unpack_from
            size = read(data, at + 4)[0]
            if size < 12 or size % 4 or size > LONGEST_BLOCK:
                return 0
            if at + size > len(data):
                return n if to_end else 0
            if read(data, at + size - 4)[0] != size:
                return 0
            at, n = at + size, n + 1
        return ALL

    # blocks begin at multiples of four of the file, and so of a part
    words = np.frombuffer(data[: min(len(data), OVERLAP) // 4 * 4], np.uint8).view("<u4")
    size = words[1:]
    swapped = size.byteswap()
    likely = ((size >= 12) & (size <= LONGEST_BLOCK) & (size % 4 == 0)) | ((swapped >= 12) & (swapped <= LONGEST_BLOCK) & (swapped % 4 == 0))
    best, where = 0, len(data)
    for i in np.flatnonzero(likely):
        n = max(blocks(4 * int(i), order) for order in "<>")
        if n == ALL:
            return 4 * int(i)
        if n > best:  # the file's end is cut off: the longest row that runs into it
            best, where = n, 4 * int(i)
    if to_end:
        return where
    raise CaptureError("no block found where a split begins; read the file whole with splitbytes=0")


def pcapng_part(load: Load, size: int, start: int, stop: int, tables: Tables) -> Iterator[tuple]:
    """The records of the blocks that begin in bytes [start, stop) of a pcapng file of ``size`` bytes, after ``tables``, piece by piece; an error at the end if the next part does not begin where they end."""

    def first(at: int) -> int:
        data = memoryview(load(at, 2 * OVERLAP))
        return at + first_block(data, at + len(data) >= size)

    end = yield from _pcapng_pieces(load, size, tables, first(start) if start else 0, stop)
    if stop < size and end != first(stop):
        raise CaptureError(APART)


def pcapng_split(data: bytes, at_start: bool, size: int, to_end: bool, found: list) -> None:
    """Gives ``found`` the sections and interfaces of the blocks that begin in the first ``size`` bytes of ``data``, which holds 2 * OVERLAP bytes more or the rest of the file."""
    buf = memoryview(data)
    at = 0 if at_start else first_block(buf[: 2 * OVERLAP], to_end and len(buf) <= 2 * OVERLAP)
    # the byte order until the first section in this part: that in which its first block's lengths agree
    tables = Tables(order=next((o for o in "<>" if at + 8 <= len(buf) and _agrees(buf, at, o)), "<"))
    last = to_end and size >= len(buf)
    *_, end = _pcapng(buf, tables, at, len(buf) if last else size, found)
    if not last and end != size + first_block(buf[size:], to_end):
        raise CaptureError(APART)


def _agrees(buf: memoryview, at: int, order: str) -> bool:
    size = struct.unpack_from(order + "I", buf, at + 4)[0]
    return 12 <= size <= len(buf) - at and struct.unpack_from(order + "I", buf, at + size - 4)[0] == size


def _decoded(buf: memoryview, off: np.ndarray, captured: np.ndarray, original: np.ndarray, us: np.ndarray, link: np.ndarray, keep: Keep | None = None) -> Packets:
    """Packets of the records whose data begin at ``off``; ``seen`` counts all of them."""
    f = Frames(buf, off, captured, original, link)
    seen = Counter(records=len(off))
    seen["ipv4"], seen["ipv6"] = int((f.ip >= 0).sum()), int(f.ip6_any.sum())
    proto, body = f.proto, f.body
    ok = (f.ip >= 0) & np.isin(proto, (TCP, UDP, ICMP)) & (body >= 0) & np.where(proto == ICMP, body <= f.end, body + 4 <= f.end)
    seen["kept"], seen["dropped"] = int(ok.sum()), int((~ok).sum())
    if keep is not None:
        ok &= keep(f)
    ip, body, proto = f.ip[ok], body[ok], proto[ok]
    port = proto != ICMP
    return Packets(f.word(ip + 12), f.word(ip + 16), np.where(port, f.short(body), 0), np.where(port, f.short(body + 2), 0), proto, original[ok], us[ok], seen)


# --- writing ------------------------------------------------------------------------------

#: Raw IP link type; 20 bytes of IP header, and 4 of TCP or UDP.
def file_header(link: int) -> bytes:
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65536, link)


FILE_HEADER = file_header(101)
CAPTURED = {TCP: 24, UDP: 24, ICMP: 20}
RECORD_BYTES = {proto: 16 + n for proto, n in CAPTURED.items()}
#: A record: its header, an IP header without options, and two ports.
_RECORD = np.dtype(
    [("sec", "<u4"), ("usec", "<u4"), ("captured", "<u4"), ("original", "<u4"), ("version", "u1"), ("tos", "u1"), ("total", ">u2"), ("id", ">u2"), ("fragment", ">u2"),
     ("ttl", "u1"), ("proto", "u1"), ("sum", ">u2"), ("src", ">u4"), ("dst", ">u4"), ("src_port", ">u2"), ("dst_port", ">u2")]
)


def record_bytes(src_ip, dst_ip, src_port, dst_port, proto, length, ts_us) -> bytes:
    """Pcap records with synthesised headers for the rows of these arrays."""
    out = np.zeros(len(proto), _RECORD)
    icmp = proto == ICMP
    out["sec"], out["usec"] = ts_us // 1_000_000, ts_us % 1_000_000
    out["captured"], out["original"] = np.where(icmp, CAPTURED[ICMP], CAPTURED[TCP]), length
    out["version"], out["total"], out["proto"] = 0x45, np.minimum(length, 65535), proto
    out["src"], out["dst"], out["src_port"], out["dst_port"] = src_ip, dst_ip, src_port, dst_port
    if not icmp.any():
        return out.tobytes()
    words = np.ones((len(out), _RECORD.itemsize // 4), bool)
    words[:, -1] = ~icmp  # no ports
    return out.view(np.uint32).reshape(words.shape)[words].tobytes()


def packet_records(src_ip, dst_ip, src_port, dst_port, proto, length, ts_us) -> bytes:
    """Pcap records for columns of any number type; packets of other protocols are an error."""
    src_ip, dst_ip, src_port, dst_port, proto, length, ts_us = (np.asarray(x, np.int64) for x in (src_ip, dst_ip, src_port, dst_port, proto, length, ts_us))
    if not np.isin(proto, list(CAPTURED)).all():
        raise ValueError("only TCP, UDP and ICMP packets can be written")
    return record_bytes(src_ip, dst_ip, src_port, dst_port, proto, length, ts_us)


def frame_records(ts_us: list[int], length: list[int], data: list[bytes]) -> bytes:
    """Pcap records of whole frames; a length that is missing or too small is that of the frame."""
    head = struct.Struct("<IIII").pack
    return b"".join(x for t, n, d in zip(ts_us, length, data, strict=True) for x in (head(t // 1_000_000, t % 1_000_000, len(d), max(n or 0, len(d))), d))
