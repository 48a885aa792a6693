"""Frame decode: link header, optional VLAN tags, IPv4 or IPv6, TCP, payload.

Headers are walked for whole Arrow batches at once (built-in functions can only read a byte of a
binary through hex text, which measured about thirty times slower).  Only the first bytes of each
frame travel to the function and only header fields come back; payloads stay where they are and are
cut out by built-in expressions.
"""

from __future__ import annotations

import socket
from collections.abc import Sequence
from functools import reduce
from ipaddress import IPv6Address
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default ports, protocol numbers and flags.
DEFAULT_PORTS = (6379, 11211)
ETHERTYPE_VLAN = (0x8100, 0x88A8)
ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_IPV6 = 0x86DD
LOOPBACK_IPV4 = 2
LOOPBACK_IPV6 = (10, 24, 28, 30)
PROTOCOL_TCP = 6
PROTOCOL_HOP_BY_HOP = 0
FLAG_FIN, FLAG_SYN, FLAG_RST = 0x01, 0x02, 0x04

# Two VLAN tags and the longest IP and TCP headers fit in the first; with the longest hop-by-hop
# header between them, in the second.
HEADER_BYTES = 14 + 8 + 60 + 60
LONG_HEADER_BYTES = 14 + 8 + 40 + 2048 + 60

_HEADER = pa.schema(
    [
        ("vlan", pa.int32()), ("ip_version", pa.int32()), ("src_ip", pa.string()),
        ("dst_ip", pa.string()), ("src_port", pa.int32()), ("dst_port", pa.int32()), ("seq", pa.int64()),
        ("ack", pa.int64()), ("flags", pa.int32()), ("body", pa.int32()), ("end", pa.int32()),
    ]
)
_HEADER_DDL = (
    "vlan int, ip_version int, src_ip string, dst_ip string, src_port int, dst_port int, seq long, "
    "ack long, flags int, body int, end int"
)


class _Frames:
    """Numbers read from the same or different places of many frames."""

    def __init__(self, heads: pa.Array):
        heads = heads.cast(pa.large_binary())
        offsets = np.frombuffer(heads.buffers()[1], dtype="int64")
        offsets = offsets[heads.offset : heads.offset + len(heads) + 1]
        stored = np.frombuffer(heads.buffers()[2] or b"", dtype="uint8")
        self.starts, self.known = offsets[:-1], np.diff(offsets)
        self.bytes = np.concatenate([stored, np.zeros(LONG_HEADER_BYTES, dtype="uint8")])

    def number(self, at, width: int) -> np.ndarray:
        """Big-endian integers at offset ``at``; -1 where a frame ends before."""
        inside = (at >= 0) & (at + width <= self.known)
        places = self.starts + np.where(inside, at, 0)
        value = np.zeros(len(places), dtype="int64")
        for i in range(width):
            value = (value << 8) | self.bytes[places + i]
        return np.where(inside, value, -1)


def _ipv6_text(high: int, low: int) -> str:
    address = IPv6Address((high % (1 << 64) << 64) | low % (1 << 64))
    return str(address.ipv4_mapped or address)


def _addresses(frames: _Frames, at4, at6, v4: np.ndarray, v6: np.ndarray) -> pa.Array:
    """Address texts; each address of a batch is written out once."""
    out = np.full(len(v4), None, dtype=object)
    numbers, which = np.unique(frames.number(at4, 4)[v4], return_inverse=True)
    texts = [socket.inet_ntoa(n.to_bytes(4, "big")) for n in numbers.tolist()]
    out[v4] = np.array([*texts, None], dtype=object)[which]
    if v6.any():
        halves = np.stack([frames.number(at6, 8)[v6], frames.number(at6 + 8, 8)[v6]], axis=1)
        pairs, which = np.unique(halves, axis=0, return_inverse=True)
        texts = [_ipv6_text(*pair) for pair in pairs.tolist()]
        out[v6] = np.array([*texts, None], dtype=object)[which.reshape(-1)]
    return pa.array(out, pa.string())


def _headers(heads: pa.Array, lengths: pa.Array) -> pa.Array:
    """Walk link, IP and TCP headers; all fields null where a frame holds no TCP.

    A frame is Ethernet if that yields an IP ethertype, else loopback.  (A loopback frame can not
    show an IP ethertype there: those bytes hold lifetime and protocol, or the start of an address
    block that is not in use.)
    """
    frames = _Frames(heads)
    number = frames.number
    total = lengths.to_numpy(zero_copy_only=False).astype("int64")

    first, second, third = (number(np.int64(12 + 4 * i), 2) for i in range(3))
    one = np.isin(first, ETHERTYPE_VLAN)
    two = one & np.isin(second, ETHERTYPE_VLAN)
    ethertype = np.where(two, third, np.where(one, second, first))
    vlan = np.where(two, number(np.int64(18), 2), np.where(one, number(np.int64(14), 2), -1))
    high, low = number(np.int64(0), 2), number(np.int64(2), 2)
    swapped = np.where(low == 0, (high >> 8) | ((high & 0xFF) << 8), -1)
    family = np.where(high == 0, low, swapped)
    ethernet = np.isin(ethertype, (ETHERTYPE_IPV4, ETHERTYPE_IPV6))
    v4 = np.where(ethernet, ethertype == ETHERTYPE_IPV4, family == LOOPBACK_IPV4)
    v6 = np.where(ethernet, ethertype == ETHERTYPE_IPV6, np.isin(family, LOOPBACK_IPV6))
    l3 = np.where(ethernet, 14 + 4 * (one.astype("int64") + two), 4)

    ihl = (number(l3, 1) & 0x0F) * 4
    length4 = number(l3 + 2, 2)
    whole = (number(l3 + 6, 2) & 0x3FFF) == 0
    tcp4 = v4 & (number(l3 + 9, 1) == PROTOCOL_TCP) & whole & (ihl >= 20)
    tcp4 &= (length4 == 0) | (length4 >= ihl)
    end4 = np.where(length4 == 0, total, np.minimum(l3 + length4, total))

    following, length6 = number(l3 + 6, 1), number(l3 + 4, 2)
    hop = following == PROTOCOL_HOP_BY_HOP
    extra = np.where(hop, (number(l3 + 41, 1) + 1) * 8, 0)
    protocol6 = np.where(hop, number(l3 + 40, 1), following)
    tcp6 = v6 & (protocol6 == PROTOCOL_TCP) & (length6 > 0)
    end6 = np.minimum(l3 + 40 + length6, total)

    l4 = np.where(tcp4, l3 + ihl, l3 + 40 + extra)
    end = np.where(v4, end4, end6)
    offset = (number(l4 + 12, 1) >> 4) * 4
    tcp = (tcp4 | tcp6) & (offset >= 20) & (l4 + 20 <= end) & (l4 + 20 <= frames.known)
    numbers = {
        "vlan": (vlan & 0x0FFF, tcp & ethernet & one),
        "ip_version": (np.where(v4, 4, 6), tcp),
        "src_port": (number(l4, 2), tcp),
        "dst_port": (number(l4 + 2, 2), tcp),
        "seq": (number(l4 + 4, 4), tcp),
        "ack": (number(l4 + 8, 4), tcp),
        "flags": (number(l4 + 13, 1), tcp),
        "body": (l4 + offset + 1, tcp),
        "end": (end + 1, tcp),
    }
    arrays = {
        "src_ip": _addresses(frames, l3 + 12, l3 + 8, tcp & tcp4, tcp & tcp6),
        "dst_ip": _addresses(frames, l3 + 16, l3 + 24, tcp & tcp4, tcp & tcp6),
    }
    for name, (values, known) in numbers.items():
        kind = _HEADER.field(name).type
        arrays[name] = pa.array(values.astype(kind.to_pandas_dtype()), mask=~known)
    return pa.StructArray.from_arrays([arrays[n] for n in _HEADER.names], fields=list(_HEADER))


def tcp_ports(data: pa.Array) -> list[pa.Array]:
    """Source and destination ports of frames, null where a frame holds no TCP."""
    walked = _headers(data, pc.binary_length(data))
    return [walked.field("src_port"), walked.field("dst_port")]


def _head() -> Column:
    """The part of a frame that can hold headers; long only behind a hop-by-hop header.

    The next-header byte is looked at where each link layer would have it, so some frames without
    such a header are sent in full length too; that costs bytes and changes nothing.
    """

    def is_at(place: int, value: int, width: int) -> Column:
        return F.substring("data", place + 1, width) == F.lit(value.to_bytes(width, "big"))

    loopback = is_at(4 + 6, PROTOCOL_HOP_BY_HOP, 1)
    tagged = [
        is_at(12 + 4 * tags, ETHERTYPE_IPV6, 2) & is_at(14 + 4 * tags + 6, PROTOCOL_HOP_BY_HOP, 1)
        for tags in range(3)
    ]
    long = reduce(or_, tagged, loopback)
    return F.when(long, F.substring("data", 1, LONG_HEADER_BYTES)).otherwise(
        F.substring("data", 1, HEADER_BYTES)
    )


def decode_frames(raw: DataFrame) -> DataFrame:
    """Decode ``data`` of raw packets; TCP columns are null where a frame holds no TCP.

    The payload ends where the IP packet does (short Ethernet frames are padded); ``truncated``
    says that less was captured than was on the wire.
    """
    # Marked so that it is not copied into filters pushed below: headers are walked once.
    headers = F.arrow_udf(_headers, _HEADER_DDL).asNondeterministic()
    walked = raw.select("*", headers(_head(), F.octet_length("data")).alias("__h"))
    h = {n: F.col(f"__h.{n}") for n in _HEADER.names}
    plain = ["vlan", "ip_version", "src_ip", "dst_ip", "src_port", "dst_port", "seq", "ack"]
    return walked.select(
        *raw.columns,
        *[h[n].alias(n) for n in plain],
        (h["flags"].bitwiseAND(F.lit(FLAG_SYN)) != 0).alias("syn"),
        (h["flags"].bitwiseAND(F.lit(FLAG_FIN)) != 0).alias("fin"),
        (h["flags"].bitwiseAND(F.lit(FLAG_RST)) != 0).alias("rst"),
        F.when(
            h["seq"].isNotNull(),
            F.substring("data", h["body"], F.greatest(h["end"] - h["body"], F.lit(0))),
        ).alias("payload"),
        (F.col("caplen") < F.col("wirelen")).alias("truncated"),
    )


def tcp_only(packets: DataFrame) -> DataFrame:
    """Frames that decoded as TCP."""
    return packets.filter(F.col("seq").isNotNull())


def check_ports(ports: Sequence[int]) -> list[int]:
    ports = list(ports)
    if not ports:
        raise ValueError("at least one port is needed")
    for p in ports:
        if not isinstance(p, int) or not 0 <= p <= 65535:
            raise ValueError(f"not a port number: {p!r}")
    return ports


def on_ports(ports: Sequence[int] = DEFAULT_PORTS) -> Column:
    """Source or destination port is in the list."""
    ports = check_ports(ports)
    return F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)


def port_filter(packets: DataFrame, ports: Sequence[int] = DEFAULT_PORTS) -> DataFrame:
    return tcp_only(packets).filter(on_ports(ports))


def largest_truncated(packets: DataFrame) -> DataFrame:
    """Number of truncated frames and the largest wire length among them."""
    cut = F.col("truncated")
    return packets.agg(
        F.count_if(cut).alias("truncated"), F.max(F.when(cut, F.col("wirelen"))).alias("largest")
    )


def with_connection(packets: DataFrame, ports: Sequence[int] = DEFAULT_PORTS) -> DataFrame:
    """Add ``from_server`` and the connection key, equal for both directions.

    A packet is from the server if its source port is in the list; a client that uses such a port
    itself is taken for a server.
    """
    from_server = F.col("src_port").isin(*check_ports(ports))
    src = [F.col("src_ip"), F.col("src_port")]
    dst = [F.col("dst_ip"), F.col("dst_port")]
    names = ["server_ip", "server_port", "client_ip", "client_port"]
    server_first = F.struct(*[c.alias(n) for c, n in zip(src + dst, names)])
    client_first = F.struct(*[c.alias(n) for c, n in zip(dst + src, names)])
    return packets.select(
        "*",
        from_server.alias("from_server"),
        F.when(from_server, server_first).otherwise(client_first).alias("conn"),
    )


def conn_label(conn: Column) -> Column:
    """``server:port -> client:port``."""
    return F.concat(
        conn.getField("server_ip"), F.lit(":"), conn.getField("server_port").cast("string"),
        F.lit(" -> "), peer_label(conn),
    )


def peer_label(conn: Column) -> Column:
    """``client:port``."""
    return F.concat(
        conn.getField("client_ip"), F.lit(":"), conn.getField("client_port").cast("string")
    )
