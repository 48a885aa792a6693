"""Capture files on disk: classic pcap and pcapng, read from any place on, payloads only where wanted.

Both formats are chains: a record or block says where the next one begins. Walking a chain reads only
heads; a payload is read if the caller wants its packet, and seeked over else.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import BinaryIO, NamedTuple

from keytide.operators.frames import (
    ETHERTYPE_IPV4,
    ETHERTYPE_IPV6,
    ETHERTYPE_VLAN,
    HEADER_BYTES,
    LOOPBACK_IPV4,
    LOOPBACK_IPV6,
    PROTOCOL_HOP_BY_HOP,
    PROTOCOL_TCP,
)

# Magic numbers (with the units per second they stand for), link types, sizes.
MAGICS = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}
LINK_TYPES = {0: "null", 1: "ethernet", 108: "loop"}
FILE_HEADER, RECORD_HEADER = 24, 16
# Fixed values of pcapng: block types, the section's byte-order magic, options of an interface.
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
ORDER_MAGIC = 0x1A2B3C4D
TIME_UNITS, TIME_OFFSET = 9, 14

#: Longest record of a capture that states no longer snap length; longer ones are taken for damage.
LONGEST_RECORD = 262144
#: Bytes asked for at least and at most, and the gap that is read over rather than seeked over.
LEAST, MOST, GAP = 512, 1 << 20, 16 << 10
_CHAIN, _DAY = 16, 86400


class BadCapture(ValueError):
    """Not a capture file this reader knows."""


def open_file(path: str) -> BinaryIO:
    """Open a local path or any URI the installed file systems know, for seeking reads."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return open(path, "rb", buffering=0)
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


class ByteReader:
    """Reads at growing places; asks for more the longer it reads on, for little after a jump."""

    def __init__(self, file: BinaryIO):
        self.file = file
        self.size = file.seek(0, 2)
        if self.size is None:
            self.size = file.tell()
        self.asked = 0
        self._start, self._held, self._ahead = 0, b"", LEAST

    def read(self, at: int, count: int) -> bytes:
        """Up to ``count`` bytes from ``at`` on, fewer at the end of the file."""
        end = self._start + len(self._held)
        if not self._start <= at or at + count > end:
            near = self._start <= at <= end + GAP
            self._ahead = min(MOST, 2 * self._ahead) if near else LEAST
            kept = self._held[at - self._start :] if self._start <= at < end else b""
            self._start, self._held = at, kept + self._fetch(at + len(kept), max(count - len(kept), self._ahead))
        low = at - self._start
        return self._held[low : low + count]

    def _fetch(self, at: int, count: int) -> bytes:
        self.file.seek(at)
        parts, left = [], min(count, self.size - at)
        while left > 0:
            part = self.file.read(left)
            if not part:
                break
            parts.append(part)
            left -= len(part)
        out = b"".join(parts)
        self.asked += len(out)
        return out


class Packet(NamedTuple):
    at: int
    us: int
    caplen: int
    wirelen: int
    linktype: int
    data: bytes


#: Whether a packet is wanted, from its time and the first bytes of its frame.
Wanted = Callable[[int, bytes], bool]


def nothing(us: int, head: bytes) -> bool:
    return False


def on_ports(ports: frozenset[int], src: frozenset[int] | None = None, dst: frozenset[int] | None = None) -> Wanted:
    """Packets that may be TCP with a port in ``ports`` on either side, and with these on the sides."""

    def wanted(us: int, head: bytes) -> bool:
        pair = possible_ports(head)
        if pair is None:
            return False
        if not pair:
            return True
        return (
            (not ports or pair[0] in ports or pair[1] in ports)
            and (src is None or pair[0] in src)
            and (dst is None or pair[1] in dst)
        )

    return wanted


def possible_ports(head: bytes) -> tuple[int, int] | tuple[()] | None:
    """Ports of a frame as frame decode finds them; ``()`` if its head does not tell, ``None`` if it is no TCP."""

    def number(at: int) -> int:
        return head[at] << 8 | head[at + 1]

    try:
        tags, kind = 0, number(12)
        while tags < 2 and kind in ETHERTYPE_VLAN:
            tags += 1
            kind = number(12 + 4 * tags)
        at = 14 + 4 * tags
        if kind not in (ETHERTYPE_IPV4, ETHERTYPE_IPV6):
            at, high, low = 4, number(0), number(2)
            family = low if high == 0 else (high >> 8 | (high & 0xFF) << 8) if low == 0 else -1
            if family == LOOPBACK_IPV4:
                kind = ETHERTYPE_IPV4
            elif family in LOOPBACK_IPV6:
                kind = ETHERTYPE_IPV6
            else:
                return None
        if kind == ETHERTYPE_IPV4:
            protocol, end = head[at + 9], at + (head[at] & 0x0F) * 4
        else:
            protocol, end = head[at + 6], at + 40
            if protocol == PROTOCOL_HOP_BY_HOP:
                protocol, end = head[at + 40], end + (head[at + 41] + 1) * 8
        return (number(end), number(end + 2)) if protocol == PROTOCOL_TCP else None
    except IndexError:
        return ()


@dataclass(frozen=True)
class Interface:
    linktype: int
    snaplen: int
    units: int  # per second
    offset: int  # seconds


@dataclass(frozen=True)
class Section:
    """What must be known to read on inside a file: byte order and interfaces (of pcap: nothing).

    A part of a file that is read from a guessed place knows neither for sure. It is left in a state whose
    order begins with ``?`` if it holds what is to be added to the state before the part, with ``!`` if a
    section began in it and the state before does not matter.
    """

    order: str = ""
    interfaces: tuple[Interface, ...] = ()

    def to_json(self) -> str:
        return json.dumps([self.order, [[i.linktype, i.snaplen, i.units, i.offset] for i in self.interfaces]])

    @staticmethod
    def of_json(text: str) -> Section:
        order, interfaces = json.loads(text)
        return Section(order, tuple(Interface(*i) for i in interfaces))

    @property
    def guessed(self) -> bool:
        return self.order.startswith("?")

    def then(self, part: Section) -> Section:
        """The state behind a part of a file, from the state before it and the one the part was left in."""
        if part.guessed:
            return replace(self, interfaces=self.interfaces + part.interfaces)
        return replace(part, order=part.order.removeprefix("!"))


class CaptureFile:
    """One open capture file; subclasses know a format's chain."""

    first = 0

    def __init__(self, path: str, reader: ByteReader):
        self.path, self.reader = path, reader
        #: Where the last walk ended, and in which state.
        self.next, self.section = self.first, Section()

    def __enter__(self) -> CaptureFile:
        return self

    def __exit__(self, *_) -> None:
        self.reader.file.close()

    def packets(self, start: int, stop: int, section: Section, wanted: Wanted | None = None) -> Iterator[Packet]:
        """Wanted packets of records that start in the range.

        A record cut off by the end of the file is left out.
        """
        raise NotImplementedError

    def guess(self, start: int, stop: int) -> tuple[int, str] | None:
        """First place in the range where a chain of plausible records starts, and the byte order there."""
        raise NotImplementedError

    def leave(self, start: int, stop: int, section: Section) -> tuple[int, Section]:
        """Offset of the first record at or after ``stop`` and the state there, by walking over heads."""
        for _ in self.packets(start, stop, section, nothing):
            pass
        return self.next, self.section

    def summary(self, start: int, stop: int) -> tuple[int, str, int | None, str | None] | None:
        """Guessed entry of a range with its byte order, and place and state in which it is left.

        A guess from which the chain cannot be walked is none.
        """
        found = self.guess(start, stop)
        if found is None:
            return None
        try:
            end, section = self.leave(found[0], stop, Section(found[1]))
        except BadCapture:
            return (*found, None, None) if start == 0 else None
        return (*found, end, section.to_json())

    def _link(self, linktype: int) -> int:
        if linktype not in LINK_TYPES:
            raise BadCapture(f"{self.path}: link type {linktype} is not supported")
        return linktype


class PcapFile(CaptureFile):
    first = FILE_HEADER

    def __init__(self, path: str, reader: ByteReader):
        super().__init__(path, reader)
        head = reader.read(0, FILE_HEADER)
        if len(head) < FILE_HEADER:
            raise BadCapture(f"{path}: shorter than a capture header")
        for order in "<>":
            (magic,) = struct.unpack(order + "I", head[:4])
            if magic in MAGICS:
                break
        else:
            raise BadCapture(f"{path}: not a capture file")
        self.units = MAGICS[magic]
        self.layout = struct.Struct(order + "IIII")
        snaplen, linktype = struct.unpack(order + "II", head[16:24])
        self.linktype = self._link(linktype & 0x0FFFFFFF)
        self.limit = max(snaplen, LONGEST_RECORD)

    def packets(self, start: int, stop: int, section: Section, wanted: Wanted | None = None) -> Iterator[Packet]:
        at, read = max(start, FILE_HEADER), self.reader.read
        while at < stop:
            head = read(at, RECORD_HEADER)
            if len(head) < RECORD_HEADER:
                break
            seconds, fraction, caplen, wirelen = self.layout.unpack(head)
            if caplen > self.limit:
                raise BadCapture(f"{self.path}: record of {caplen} bytes at {at}")
            body = at + RECORD_HEADER
            if body + caplen > self.reader.size:
                break
            us = seconds * 1_000_000 + fraction * 1_000_000 // self.units
            if wanted is None or wanted is not nothing and wanted(us, read(body, min(caplen, HEADER_BYTES))):
                yield Packet(at, us, caplen, wirelen, self.linktype, read(body, caplen))
            at = body + caplen
        self.next, self.section = at, section

    def guess(self, start: int, stop: int) -> tuple[int, str] | None:
        if start <= FILE_HEADER:
            return FILE_HEADER, ""
        window = self.reader.read(start, min(stop - start, LONGEST_RECORD + RECORD_HEADER) + (_CHAIN + 1) * 4096)
        weak = None
        for at in range(min(stop - start, len(window) - RECORD_HEADER + 1)):
            seen = self._plausible(window, at)
            if seen == _CHAIN:
                return start + at, ""
            if seen and weak is None:
                weak = start + at, ""
        return weak

    def _plausible(self, window: bytes, at: int) -> int:
        """Length of the chain of records at a place, as far as the window shows it; 0 if there is none.

        A chain that ends beyond the window must be within a day.
        """
        first, near = None, True
        for n in range(_CHAIN):
            if at + RECORD_HEADER > len(window):
                return n if near else 0
            seconds, fraction, caplen, wirelen = self.layout.unpack_from(window, at)
            if fraction >= self.units or not 0 < caplen <= min(wirelen, self.limit):
                return 0
            first = seconds if first is None else first
            near = near and abs(seconds - first) <= _DAY
            at += RECORD_HEADER + caplen
        return _CHAIN


class PcapngFile(CaptureFile):
    """Blocks with their length at both ends; sections with a byte order and interfaces of their own."""

    def packets(self, start: int, stop: int, section: Section, wanted: Wanted | None = None) -> Iterator[Packet]:
        at, read, size = start, self.reader.read, self.reader.size
        order, interfaces = section.order, list(section.interfaces)
        while at < stop:
            head = read(at, 28)
            if len(head) < 12:
                break
            if head[:4] == SECTION.to_bytes(4, "big"):
                order, interfaces = "!" + _order_of(self.path, head, at), []
            kind, length = struct.unpack_from(order[-1] + "II", head)
            if length < 12 or length % 4:
                raise BadCapture(f"{self.path}: block of {length} bytes at {at}")
            if at + length > size:
                break
            if kind == INTERFACE:
                interfaces.append(self._interface(read(at + 8, length - 12), order[-1]))
            elif kind in (PACKET, OLD_PACKET, SIMPLE_PACKET) and wanted is not nothing:
                found = self._packet(at, kind, length, head, order[-1], interfaces)
                us, caplen, wirelen, linktype, body = found
                if wanted is None or wanted(us, read(body, min(caplen, HEADER_BYTES))):
                    yield Packet(at, us, caplen, wirelen, self._link(linktype), read(body, caplen))
            at += length
        self.next, self.section = at, Section(order, tuple(interfaces))

    def _interface(self, body: bytes, order: str) -> Interface:
        linktype, _, snaplen = struct.unpack_from(order + "HHI", body)
        units, offset, at = 1_000_000, 0, 8
        while at + 4 <= len(body):
            code, count = struct.unpack_from(order + "HH", body, at)
            value = body[at + 4 : at + 4 + count]
            if code == 0:
                break
            if code == TIME_UNITS and value:
                units = (2 if value[0] & 0x80 else 10) ** (value[0] & 0x7F)
            elif code == TIME_OFFSET and len(value) == 8:
                (offset,) = struct.unpack(order + "q", value)
            at += 4 + (count + 3) // 4 * 4
        return Interface(linktype, snaplen, units, offset)

    def _packet(self, at: int, kind: int, length: int, head: bytes, order: str, interfaces: list) -> tuple:
        """``us, caplen, wirelen, linktype, place of the frame``; simple packets have no time, so the epoch."""
        number, high, low, caplen, body = 0, 0, 0, 0, at + 28
        if kind == SIMPLE_PACKET:
            (wirelen,) = struct.unpack_from(order + "I", head, 8)
            body = at + 12
        elif kind == PACKET:
            number, high, low, caplen, wirelen = struct.unpack_from(order + "IIIII", head, 8)
        else:
            number, _, high, low, caplen, wirelen = struct.unpack_from(order + "HHIIII", head, 8)
        if number >= len(interfaces):
            raise BadCapture(f"{self.path}: packet of an unknown interface at {at}")
        interface = interfaces[number]
        if kind == SIMPLE_PACKET:
            caplen = min(wirelen, length - 16, interface.snaplen or wirelen)
            us = 0
        else:
            us = (high << 32 | low) * 1_000_000 // interface.units + interface.offset * 1_000_000
        if body + caplen > at + length - 4:
            raise BadCapture(f"{self.path}: packet beyond its block at {at}")
        return us, caplen, wirelen, interface.linktype, body

    def guess(self, start: int, stop: int) -> tuple[int, str] | None:
        if start == 0:
            return 0, ""
        # Blocks begin at multiples of four. What is before a block ends with a length, too.
        back = min(start, LONGEST_RECORD)
        window = self.reader.read(start - back, back + min(stop - start, 2 * LONGEST_RECORD) + (_CHAIN + 1) * 4096)
        low = back + -start % 4
        for at in range(low, min(back + stop - start, len(window) - 11), 4):
            for order in "<>":
                if self._plausible(window, at, order):
                    return start - back + at, "?" + order
        return None

    @staticmethod
    def _plausible(window: bytes, at: int, order: str) -> bool:
        number = struct.Struct(order + "I")

        def block(place: int) -> int:
            """Length of the block at a place, 0 if there is none, -1 if the window does not tell."""
            if place + 12 > len(window):
                return -1
            if window[place : place + 4] == SECTION.to_bytes(4, "big") and number.unpack_from(window, place + 8)[0] != ORDER_MAGIC:
                return 0
            (length,) = number.unpack_from(window, place + 4)
            if length < 12 or length % 4:
                return 0
            if place + length > len(window):
                return -1
            return length if number.unpack_from(window, place + length - 4)[0] == length else 0

        (before,) = number.unpack_from(window, at - 4)
        if before < 12 or before % 4 or before <= at and block(at - before) != before:
            return False
        for n in range(_CHAIN):
            length = block(at)
            if length <= 0:
                # A block may end beyond the window; one of them alone is not enough.
                return length < 0 and n > 0
            at += length
            if at + 12 <= len(window) and window[at : at + 4] == SECTION.to_bytes(4, "big"):
                return True  # the next section may have another order
        return True


def _order_of(path: str, head: bytes, at: int) -> str:
    for order in "<>":
        if struct.unpack_from(order + "I", head, 8)[0] == ORDER_MAGIC:
            return order
    raise BadCapture(f"{path}: section without a byte order at {at}")


def open_capture(path: str) -> CaptureFile:
    """Open a capture file of either format."""
    reader = ByteReader(open_file(path))
    try:
        if reader.read(0, 4) == SECTION.to_bytes(4, "big"):
            return PcapngFile(path, reader)
        return PcapFile(path, reader)
    except BadCapture:
        reader.file.close()
        raise
