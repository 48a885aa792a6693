"""Registered queries of capture files: frames of the order table written out in both formats and read back."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from checks.packet_queries import ORDERS, order_frames
from keytide.operators import frames as D
from keytide.plans.cut import shared_folder
from keytide.sources.captures import BATCH_RECORDS, read_captures, register_pcap, stream_captures

QUERIES, SQL = {}, {}
PORTS = [6379, 11211]
#: Frames of a file on average, where there are enough for four files.
FILE_FRAMES = 400_000


def check(name, sql=None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def _records(rows: list[tuple]) -> bytes:
    """A pcap file's records."""
    parts = []
    for us, wirelen, _, data in rows:
        parts += [struct.pack(">IIII", us // 10**6, us % 10**6, len(data), wirelen), data]
    return b"".join(parts)


def _blocks(rows: list[tuple]) -> bytes:
    """A pcapng file's packet blocks, times in nanoseconds on the second interface."""
    parts = []
    for us, wirelen, linktype, data in rows:
        number = int(linktype == 0)
        ticks = us * (1000 if number else 1)
        pad = -len(data) % 4
        size = 32 + len(data) + pad
        head = struct.pack("<IIIIIII", 6, size, number, ticks >> 32, ticks & 0xFFFFFFFF, len(data), wirelen)
        parts += [head, data, bytes(pad), struct.pack("<I", size)]
    return b"".join(parts)


_PCAP_HEAD = {k: struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, k) for k in (0, 1)}
_NG_HEAD = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28) + b"".join(
    [
        struct.pack("<IIHHII", 1, 20, 1, 0, 0, 20),
        struct.pack("<IIHHIHHB3xHHI", 1, 32, 0, 0, 0, 9, 1, 9, 0, 0, 32),
    ]
)


def written(spark, frames) -> str:
    """A shared folder with the frames as ``pcap`` files (one for each link type) and as ``pcapng`` files."""
    folder = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def opened(name: str, head: bytes) -> pa.NativeFile:
            system, path = fs.FileSystem.from_uri(f"{folder if '://' in folder else 'file://' + folder.removeprefix('file:')}/{name}")
            system.create_dir(path.rpartition("/")[0])
            out = system.open_output_stream(path)
            out.write(head)
            return out

        part = TaskContext.get().partitionId()
        plain = {k: opened(f"pcap/part-{part}-{k}", _PCAP_HEAD[k]) for k in (0, 1)}
        blocks = opened(f"pcapng/part-{part}", _NG_HEAD)
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH_RECORDS):
                rows = list(zip(*batch.slice(low, BATCH_RECORDS).to_pydict().values()))
                for k, out in plain.items():
                    out.write(_records([r for r in rows if r[2] == k]))
                blocks.write(_blocks(rows))
        for out in (*plain.values(), blocks):
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])

    plain = frames.select(F.unix_micros("ts").alias("us"), "wirelen", "linktype", "data")
    parts = max(4, frames.count() // FILE_FRAMES)
    written = plain.repartition(parts, "us", "data").mapInArrow(write, "part int")
    written.write.format("noop").mode("overwrite").save()
    return folder


_PACKETS = (
    ORDERS
    + """SELECT {formats} AS format, (k * 7919) % 4294967296 AS seq, src_port, dst_port, kind = 0 AS truncated,
                CAST(ts AS TIMESTAMP) AS ts, CASE WHEN kind = 0 THEN body[1:length(body) - 3] ELSE body END AS body
         FROM p WHERE src_port IN (6379, 11211) OR dst_port IN (6379, 11211)"""
)


def _decoded(raw):
    found = D.port_filter(D.decode_frames(raw), PORTS)
    return found.select(
        F.when(F.col("file").contains("/pcapng/"), "pcapng").otherwise("pcap").alias("format"),
        "seq", "src_port", "dst_port", "truncated",
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.decode("payload", "utf-8").alias("body"),
    )


@check("s1_f1_capture_files", _PACKETS.format(formats="unnest(['pcap', 'pcapng'])"))
def capture_files(spark, sf):
    """Both formats in splits of 100 KB, other ports left out where the files are read."""
    folder = written(spark, order_frames(spark, sf))
    return _decoded(read_captures(spark, folder, 100_000, PORTS))


@check("s2_landing_captures", _PACKETS.format(formats="unnest(['pcap', 'pcapng'])"))
def landing_captures(spark, sf):
    """The same files as they would land, four at a trigger."""
    folder = written(spark, order_frames(spark, sf))
    for kind in ("pcap", "pcapng"):
        stream = stream_captures(spark, f"{folder}/{kind}", files_per_trigger=4, split_bytes=100_000)
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state-{kind}")
        query.format("parquet").option("path", f"{folder}/out/{kind}").start().awaitTermination()
    raw = spark.read.parquet(f"{folder}/out/pcap").unionByName(spark.read.parquet(f"{folder}/out/pcapng"))
    return _decoded(raw)


@check(
    "f1_pushed_ports",
    ORDERS + "SELECT src_port, dst_port, count(*) AS n FROM p WHERE dst_port IN (6379, 80) GROUP BY ALL",
)
def pushed_ports(spark, sf):
    """A condition on a port column, pushed into the format's reader."""
    register_pcap(spark)
    folder = written(spark, order_frames(spark, sf))
    found = spark.read.format("pcap").load(f"{folder}/pcap").filter(F.col("dst_port").isin(6379, 80))
    return found.groupBy("src_port", "dst_port").agg(F.count(F.lit(1)).alias("n"))
