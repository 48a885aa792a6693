"""pcapng files, ports at the source, and reads that skip payloads."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from keytide.operators.frames import decode_frames, port_filter
from keytide.sources.captures import read_captures, register_pcap, stream_captures
from keytide.sources.formats import LEAST, Section, on_ports, open_capture, possible_ports
from tests.test_captures import capture_bytes, frame


def block(order, kind, body, options=b""):
    body += b"\0" * (-len(body) % 4) + options
    size = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + size + body + size


def section(order="<"):
    return block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))


def interface(order="<", linktype=1, snaplen=0, options=b""):
    return block(order, 1, struct.pack(order + "HHI", linktype, 0, snaplen), options)


def packet(order, us, data, number=0, units=1_000_000, wirelen=None, shift=0):
    ticks = (us - shift * 1_000_000) * units // 1_000_000
    head = struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data) + 2 if wirelen is None else wirelen)
    return block(order, 6, head + data)


def random_pcapng(rng, records):
    """Sections of both orders with several interfaces, other blocks between, and packets of three kinds."""
    parts, order, count = [], "<", 0
    resolution = {"<": [], ">": []}
    for n, (us, data) in enumerate(records):
        if n % 40 == 0:
            order, count, resolution = rng.choice("<>"), 0, []
            parts.append(section(order))
        while count == 0 or rng.random() < 0.05:
            code, units = rng.choice([(6, 10**6), (9, 10**9), (0x80 | 20, 1 << 20)])
            shift = rng.choice([0, 1000])
            options = struct.pack(order + "HHB3x", 9, 1, code) + struct.pack(order + "HHq", 14, 8, shift) + struct.pack(order + "HH", 0, 0)
            parts.append(interface(order, options=options))
            resolution.append((units, shift))
            count += 1
        if rng.random() < 0.2:
            parts.append(block(order, rng.choice([4, 5, 0x40000BAD]), rng.randbytes(rng.randrange(50))))
        number = rng.randrange(count)
        units, shift = resolution[number]
        parts.append(packet(order, us, data, number, units, shift=shift))
    return b"".join(parts)


def test_pcapng_like_pcap_at_every_split_size(spark, tmp_path):
    rng = random.Random(1)
    inner = section() + interface() + packet("<", 5, b"not a packet") * 3  # blocks inside payloads
    records = [
        (10**15 + i * 1024, rng.choice([b"", b"\0" * 40, inner * rng.randrange(4), rng.randbytes(rng.randrange(1500))]))
        for i in range(150)
    ]
    (tmp_path / "ng").mkdir()
    (tmp_path / "old").mkdir()
    (tmp_path / "ng" / "a.pcapng").write_bytes(random_pcapng(rng, records) + b"\6\0\0\0\xff\0")
    (tmp_path / "old" / "a.pcap").write_bytes(capture_bytes(records))
    columns = ["ts", "caplen", "wirelen", "linktype", "data"]
    old = read_captures(spark, str(tmp_path / "old")).orderBy("ord").select(*columns).collect()
    assert [bytes(r["data"]) for r in old] == [d for _, d in records]
    for split in (64, 501, 4000, 1 << 20):
        new = read_captures(spark, str(tmp_path / "ng"), split).orderBy("ord").select(*columns).collect()
        assert [tuple(r)[1:] for r in new] == [tuple(r)[1:] for r in old], split
        assert all(abs((a["ts"] - b["ts"]).total_seconds()) < 2e-6 for a, b in zip(new, old))  # units of 2**-20


def test_pcapng_packets_without_interface_number_or_time(spark, tmp_path):
    order = ">"
    old = struct.pack(order + "HHIIII", 0, 0, 0, 7_000_000, 3, 9) + b"abc"
    data = section(order) + interface(order, snaplen=4) + block(order, 3, struct.pack(order + "I", 9) + b"wxyz") + block(order, 2, old)
    (tmp_path / "a.pcapng").write_bytes(data)
    rows = read_captures(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(bytes(r["data"]), r["caplen"], r["wirelen"], int(r["ts"].timestamp())) for r in rows] == [(b"wxyz", 4, 9, 0), (b"abc", 3, 9, 7)]


def test_damaged_pcapng(spark, tmp_path):
    cases = {
        "no interface": section() + packet("<", 5, b"x"),
        "length": section() + struct.pack("<II", 6, 13) + b"\0" * 20,
        "order": b"\x0a\x0d\x0d\x0a" + b"\0" * 24,
        "link type": section() + interface(linktype=101) + packet("<", 5, b"x"),
        "beyond": section() + interface() + block("<", 6, struct.pack("<IIIII", 0, 0, 5, 400, 400) + b"x"),
    }
    for name, data in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_bytes(data)
        with pytest.raises(Exception, match="section|block|interface|link type"):
            read_captures(spark, str(tmp_path / name)).count()


def tcp(i, sport, dport, body):
    return frame((None, None, None, f"10.0.0.{i % 250}", "10.0.0.9", sport, dport, i, 0, False, False, False, body))


def test_records_beyond_the_usual_length_follow_the_snap_length(spark, tmp_path):
    data = b"x" * 300_000
    (tmp_path / "a.pcap").write_bytes(capture_bytes([(10**15, data), (10**15 + 1, b"y")], snaplen=400_000))
    assert [r["caplen"] for r in read_captures(spark, str(tmp_path)).orderBy("ord").collect()] == [300_000, 1]


def test_ports_at_the_source(spark, tmp_path):
    rng = random.Random(2)
    rows = [(10**15 + i, tcp(i, *rng.choice([(6379, 40000), (40001, 6379), (80, 5000), (11211, 1)]), b"b" * i)) for i in range(300)]
    rows += [(10**15 + 300 + i, rng.randbytes(rng.randrange(200))) for i in range(100)] + [(10**15, rows[0][1][:40])]
    rng.shuffle(rows)
    (tmp_path / "a.pcap").write_bytes(capture_bytes(rows))
    (tmp_path / "b.pcapng").write_bytes(random_pcapng(rng, rows))
    path, ports = str(tmp_path), [6379, 11211]
    every = port_filter(decode_frames(read_captures(spark, path)), ports).select("file", "ord", "data")
    for split in (1 << 20, 3000):
        kept = read_captures(spark, path, split, ports)
        assert kept.count() < 2 * len(rows) - 100
        found = port_filter(decode_frames(kept), ports).select("file", "ord", "data")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect()))


def test_filters_reach_the_pcap_source(spark, tmp_path):
    register_pcap(spark)
    rng = random.Random(3)
    rows = [(10**15 + i, tcp(i, rng.choice([6379, 80]), rng.choice([6379, 40000]), b"x" * 9)) for i in range(200)] + [(10**15, b"none")]
    (tmp_path / "a.pcap").write_bytes(capture_bytes(rows))
    whole = spark.read.format("pcap").load(str(tmp_path))
    assert whole.count() == 201 and whole.filter("src_port is null").count() == 1
    kept = spark.read.format("pcap").load(str(tmp_path)).filter("src_port in (6379, 1) and dst_port = 40000")
    plan = spark._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [In(src_port, [1,6379]), EqualTo(dst_port,40000)]" in plan
    assert "src_port" not in plan.split("Condition")[1].splitlines()[0]  # nothing left to look for but nulls
    decoded = decode_frames(read_captures(spark, str(tmp_path)))
    assert kept.count() == decoded.filter("src_port = 6379 and dst_port = 40000").count() > 10
    either = spark.read.format("pcap").option("ports", "6379").load(str(tmp_path))
    assert either.count() == port_filter(decoded, [6379]).count()


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_payloads_of_other_ports_are_not_read(tmp_path, kind):
    rng = random.Random(4)
    rows = [(10**15 + i, tcp(i, 6379 if i % 10 == 0 else 80, 4000, bytes(60_000))) for i in range(200)]
    data = capture_bytes(rows) if kind == "pcap" else section() + interface() + b"".join(packet("<", *r) for r in rows)
    (tmp_path / "f").write_bytes(data)
    with open_capture(str(tmp_path / "f")) as capture:
        found = list(capture.packets(0, 1 << 62, Section(), on_ports(frozenset([6379]))))
        matching = sum(16 + len(d) for _, d in rows[::10])
        assert [p.data for p in found] == [d for _, d in rows[::10]]
        assert capture.reader.asked <= 1.1 * matching + len(rows) * LEAST
    with open_capture(str(tmp_path / "f")) as capture:  # all of a file is read once
        assert len(list(capture.packets(0, 1 << 62, Section()))) == 200
        assert capture.reader.asked <= 1.1 * len(data)
    assert possible_ports(rng.randbytes(5)) == ()


def test_landing_files_are_split(spark, tmp_path):
    rng = random.Random(5)
    records = [(10**15 + i, rng.randbytes(900)) for i in range(400)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcapng").write_bytes(random_pcapng(rng, records))
    stream = stream_captures(spark, str(tmp_path / "in"), split_bytes=20_000)
    tasks = stream.withColumn("task", F.spark_partition_id())
    query = (
        tasks.writeStream.format("memory").queryName("split_landing").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "ck")).start()
    )
    query.awaitTermination()
    rows = spark.table("split_landing").orderBy("ord").collect()
    assert [bytes(r["data"]) for r in rows] == [d for _, d in records]
    assert len({r["task"] for r in rows}) > 1
