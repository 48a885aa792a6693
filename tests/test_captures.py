"""Capture files: formats, splits, streams, and argument checks."""

import random
import struct

import pytest

from keytide.operators.frames import decode_frames, tcp_only
from keytide.plans.capture import capture_hot_keys, raw_packets
from keytide.operators.report import HotKeys
from keytide.sources.captures import read_captures, register_pcap, stream_captures
from keytide.sources.formats import open_capture
from tests.traffic import Wire, random_exchanges

FORMATS = {"micro-le": ("<", 0xA1B2C3D4), "micro-be": (">", 0xA1B2C3D4), "nano-le": ("<", 0xA1B23C4D),
           "nano-be": (">", 0xA1B23C4D)}


def capture_bytes(records, order="<", magic=0xA1B2C3D4, linktype=1, snaplen=262144):
    units = 1 if magic == 0xA1B2C3D4 else 1000
    out = [struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, snaplen, linktype)]
    for us, data in records:
        out.append(struct.pack(order + "IIII", us // 10**6, us % 10**6 * units, len(data), len(data) + 2))
        out.append(data)
    return b"".join(out)


def frame(row):
    _, _, _, src, dst, sport, dport, seq, ack, syn, _, _, payload = row
    tcp = struct.pack(">HHIIBBHHH", sport, dport, seq, ack, 0x50, 2 if syn else 0x18, 65535, 0, 0) + payload
    addresses = bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 1, 0, 64, 6, 0) + addresses
    return b"\2\0\0\0\0\1\2\0\0\0\0\2\x08\0" + ip + tcp


@pytest.mark.parametrize("kind", FORMATS)
def test_formats(spark, tmp_path, kind):
    order, magic = FORMATS[kind]
    records = [(10**15 + i * 1_000_003, bytes([i]) * i) for i in range(10)]
    (tmp_path / "a.pcap").write_bytes(capture_bytes(records, order, magic))
    rows = read_captures(spark, str(tmp_path)).orderBy("ord").collect()
    assert [bytes(r["data"]) for r in rows] == [d for _, d in records]
    assert [(r["caplen"], r["wirelen"], r["linktype"]) for r in rows] == [(i, i + 2, 1) for i in range(10)]
    assert [int(r["ts"].timestamp() * 10**6 + 0.5) for r in rows] == [us for us, _ in records]


@pytest.mark.parametrize("split_bytes", [500, 3000, 1 << 20])
def test_splits_give_every_record_once(spark, tmp_path, split_bytes):
    rng = random.Random(1)
    fake = struct.pack("<IIII", 10**9, 5, 4, 4) + b"abcd"
    records = [
        (10**15 + i, rng.choice([b"", b"\0" * 40, fake * rng.randrange(60), rng.randbytes(rng.randrange(1500))]))
        for i in range(200)
    ]
    (tmp_path / "a.pcap").write_bytes(capture_bytes(records) + b"\1\2\3")
    (tmp_path / "b.pcap").write_bytes(capture_bytes(records[:3]))
    rows = read_captures(spark, str(tmp_path), split_bytes).orderBy("file", "ord").collect()
    assert [bytes(r["data"]) for r in rows] == [d for _, d in records + records[:3]]


def test_short_splits_share_tasks(spark, tmp_path):
    """A split is not worth a task of its own: there are as many tasks as the bytes need, or as run at once."""
    records = [(10**15 + i, bytes([i % 256]) * 300) for i in range(500)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.pcap").write_bytes(capture_bytes(records))
    found = read_captures(spark, str(tmp_path), 1000)
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    rows = found.orderBy("file", "ord").collect()
    assert [bytes(r["data"]) for r in rows] == [d for _, d in records * 2]
    assert read_captures(spark, str(tmp_path), 100_000).rdd.getNumPartitions() <= 4  # never more than splits


def test_guesses_hold_where_times_jump(tmp_path):
    """Records days apart: a split still finds its first record, not a place that a length beyond its end makes look like one."""
    rng = random.Random(2)
    odd = struct.pack("<IIII", 5, 5, 200_000, 200_000)  # would end behind all that a guess sees
    records = [(rng.randrange(10**9) * 10**6, odd * 2 + rng.randbytes(80)) for _ in range(3000)]
    (tmp_path / "a.pcap").write_bytes(capture_bytes(records))
    places, at = set(), 24
    for _, data in records:
        places.add(at)
        at += 16 + len(data)
    with open_capture(str(tmp_path / "a.pcap")) as capture:
        for start in range(20_000, at - 20_000, 20_000):
            entry, _, leave, _ = capture.summary(start, start + 20_000)
            assert {entry, leave} <= places and entry - start < 16 + len(records[0][1])


def test_pcap_format(spark, tmp_path):
    register_pcap(spark)
    records = [(10**15 + i, b"x" * i) for i in range(2500)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.pcap").write_bytes(capture_bytes(records))
    frame_ = spark.read.format("pcap").load(str(tmp_path))
    assert frame_.count() == 5000
    assert frame_.selectExpr("sum(octet_length(data))").first()[0] == 2 * sum(range(2500))


def test_unknown_files(spark, tmp_path):
    for name, data in {"short": b"abc", "magic": b"\0" * 40, "link": capture_bytes([], linktype=101)}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.pcap").write_bytes(data)
        with pytest.raises(Exception, match="capture|link type"):
            read_captures(spark, str(tmp_path / name)).count()


def test_capture_to_report(spark, tmp_path):
    exchanges, want = random_exchanges(3)
    wire = Wire()
    wire.talk(exchanges, piece=300)
    (tmp_path / "a.pcap").write_bytes(capture_bytes([(10**15 + i, frame(r)) for i, r in enumerate(wire.rows)]))
    hot = capture_hot_keys(raw_packets(spark, str(tmp_path)), HotKeys("key,sum(size)", top=5))
    top = sorted(((-s, k) for _, k, s in want))[:5]
    assert [(-r["sum(size)"], r["key"]) for r in hot.collect()] == top


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        records = [(10**15 + n * 1000 + i, bytes([n, i])) for i in range(4)]
        (tmp_path / "in" / f"{n}.pcap").write_bytes(capture_bytes(records))
    stream = stream_captures(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = (
        stream.writeStream.format("memory").queryName("landed").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "ck")).start()
    )
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    rows = spark.table("landed").orderBy("ts").collect()
    assert [bytes(r["data"]) for r in rows] == [bytes([n, i]) for n in range(3) for i in range(4)]


def test_exactly_one_source(spark, tmp_path):
    table = spark.createDataFrame([], "a int")
    with pytest.raises(ValueError):
        raw_packets(spark)
    with pytest.raises(ValueError):
        raw_packets(spark, str(tmp_path), table)
    with pytest.raises(ValueError):
        raw_packets(spark, packets=table)
    with pytest.raises(ValueError):
        raw_packets(spark, str(tmp_path), ports=[])
    with pytest.raises(ValueError):
        raw_packets(spark, str(tmp_path), ports=[70000])


def test_frames_that_are_not_tcp(spark):
    whole = frame(("f", 0, None, "10.0.0.1", "10.0.0.2", 1, 6379, 5, 0, False, False, False, b"hello"))
    inner = whole[14:]
    cases = {
        "plain": whole,
        "tagged twice": whole[:12] + b"\x88\xa8\0\1\x81\0\0\2\x08\0" + inner,
        "loopback": b"\x02\0\0\0" + inner,
        "loopback big endian": b"\0\0\0\x02" + inner,
        "udp": whole[:23] + b"\x11" + whole[24:],
        "fragment": whole[:20] + b"\x20\0" + whole[22:],
        "later fragment": whole[:20] + b"\0\x10" + whole[22:],
        "cut header": whole[:40],
        "arp": whole[:12] + b"\x08\x06" + inner,
        "empty": b"",
        "bad offset": whole[:46] + b"\x40" + whole[47:],
        "length unset": whole[:16] + b"\0\0" + whole[18:],
        "ipv6 hop by hop": whole[:12] + b"\x86\xdd" + b"\x60\0\0\0" + struct.pack(">H", 8 + len(inner) - 20)
        + b"\0\x40" + b"\0" * 15 + b"\1" + b"\xfe\x80" + b"\0" * 13 + b"\2" + b"\6\0" + b"\0" * 6 + inner[20:],
    }
    # Extension headers are 8 to 2048 bytes long.
    long = {f"ipv6 hop by hop {8 * (n + 1)}": n for n in (12, 40, 60, 255)}
    for (name, n), tags in zip(long.items(), (b"", b"\x81\0\0\2", b"\x88\xa8\0\1\x81\0\0\2", b"")):
        length = struct.pack(">H", 8 * (n + 1) + len(inner) - 20)
        ipv6 = b"\x60\0\0\0" + length + b"\0\x40" + b"\0" * 15 + b"\1" + b"\xfe\x80" + b"\0" * 13 + b"\2"
        header = bytes([6, n]) + b"\1" * (8 * (n + 1) - 2)
        link = whole[:12] + tags + b"\x86\xdd" if n < 255 else b"\x1e\0\0\0"
        cases[name] = link + ipv6 + header + inner[20:]
    rows = [(k, 0, None, len(v), len(v), 1, v) for k, v in cases.items()]
    raw = spark.createDataFrame(rows, "file string, ord long, ts timestamp, caplen int, wirelen int, linktype int, data binary")
    found = {r["file"]: r for r in tcp_only(decode_frames(raw)).collect()}
    assert set(found) == {
        "plain", "tagged twice", "loopback", "loopback big endian", "length unset", "ipv6 hop by hop", *long
    }
    assert all(bytes(r["payload"]) == b"hello" and r["dst_port"] == 6379 for r in found.values())
    assert {found[k]["src_ip"] for k in long} == {"::1"}
    assert found["tagged twice"]["vlan"] == 2 and found["plain"]["vlan"] is None
    assert (found["ipv6 hop by hop"]["src_ip"], found["ipv6 hop by hop"]["dst_ip"]) == ("::1", "fe80::2")
