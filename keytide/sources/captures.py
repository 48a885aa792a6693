"""Capture files (pcap and pcapng) as raw packets.

Large files are read in splits. Records carry no markers, so each split first guesses where its first
record starts, and the guesses are checked against where the split before it ends; a wrong guess is
replaced by the true place. What a pcapng split must know of the file before it (byte order, interfaces)
is handed on in the same pass over one short row per split. ``ord`` is a record's byte offset, unique and
increasing within its file. With ``ports``, payloads of packets that cannot be TCP on one of them are never
read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from keytide.operators.frames import check_ports, tcp_ports
from keytide.sources.formats import BadCapture, CaptureFile, Section, Wanted, on_ports, open_capture

__all__ = ["RAW_SCHEMA", "BadCapture", "read_captures", "register_pcap", "stream_captures"]

RAW_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("caplen", T.IntegerType()),
        T.StructField("wirelen", T.IntegerType()),
        T.StructField("linktype", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)
_TYPES = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), *[pa.int32()] * 3, pa.binary()]

BATCH_RECORDS, BATCH_BYTES = 1000, 8 << 20
SPLIT_BYTES = 64 << 20
#: Bytes that are worth a task: one reads several splits that are shorter, except where there are tasks for all.
TASK_BYTES = 8 << 20
#: Tasks of one reading; with more splits than these a task reads several.
MOST_TASKS = 100_000


def _batches(
    capture: CaptureFile, start: int, stop: int, section: Section, wanted: Wanted | None
) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
        return pa.RecordBatch.from_arrays(columns, RAW_SCHEMA.names)

    for p in capture.packets(start, stop, section, wanted):
        rows.append((capture.path, *p))
        size += p.caplen
        if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _wanted(ports: Sequence[int] | None) -> Wanted | None:
    return None if ports is None else on_ports(frozenset(check_ports(ports)))


def _read_files(files: DataFrame, split_bytes: int, ports: Sequence[int] | None, tasks: int) -> DataFrame:
    """Packets of the files ``path, length``; nothing here keeps state, so files may come as a stream.

    The number of tasks is stated: rows of splits are short, and Spark would put them all together.
    """
    wanted = _wanted(ports)
    step = F.lit(split_bytes).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), step)
    splits = files.select("path", "length", F.explode(starts).alias("start")).withColumn("stop", F.col("start") + step)
    known = "path string, start long, stop long, section string"

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "start", "stop", "entry", "order", "leave", "section"]
        for batch in batches:
            rows = []
            for name, start, stop in batch.itertuples(index=False, name=None):
                with open_capture(name) as capture:
                    rows.append((name, start, stop, *(capture.summary(start, stop) or [None] * 4)))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One short row per split; those of a file are all here.
        rows = sorted((r for b in batches for r in b.itertuples(index=False, name=None)), key=lambda r: (r[0], r[1]))
        out, name, at, section = [], None, 0, Section()
        for path, start, stop, entry, order, leave, left in rows:
            if path != name:
                name, at, section = path, int(entry), Section()
            out.append((path, at, stop, section.to_json()))
            if at >= stop:
                continue
            if not pd.isna(leave) and entry == at and order.removeprefix("?") == section.order:
                at, section = int(leave), section.then(Section.of_json(left))
            else:
                with open_capture(path) as capture:
                    at, changed = capture.leave(at, stop, section)
                    section = section.then(changed)
        yield pd.DataFrame(out, columns=["path", "start", "stop", "section"], dtype=object)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_capture(row["path"]) as capture:
                    yield from _batches(capture, row["start"], row["stop"], Section.of_json(row["section"]), wanted)

    # Files of one split need no guess; the others report one short row per split.
    one = F.col("length") <= step
    whole = splits.filter(one).select("path", "start", "stop", F.lit(Section().to_json()).alias("section"))
    confirmed = (
        splits.filter(~one).select("path", "start", "stop").repartition(tasks, "path", "start")
        .mapInPandas(guess, "path string, start long, stop long, entry long, order string, leave long, section string")
        .repartition("path")
        .mapInPandas(confirm, known)
    )
    return whole.unionByName(confirmed).repartition(tasks, "path", "start").mapInArrow(read, RAW_SCHEMA)


def read_captures(
    spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, ports: Sequence[int] | None = None
) -> DataFrame:
    """Raw packets of all capture files under ``path``, large files read in parallel splits.

    With ``ports`` only packets that may be TCP on one of them; frame decode tells for sure. The files are
    listed once to count the splits.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    length = F.col("length")
    counts = [F.sum(F.ceil(length / split_bytes)), F.sum(length)]
    splits, size = files.agg(*[F.coalesce(c, F.lit(0)) for c in counts]).first()
    tasks = min(splits, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), MOST_TASKS)
    return _read_files(files, split_bytes, ports, max(1, tasks))


def stream_captures(
    spark: SparkSession,
    path: str,
    files_per_trigger: int = 8,
    split_bytes: int = SPLIT_BYTES,
    ports: Sequence[int] | None = None,
) -> DataFrame:
    """Raw packets of capture files as they land under ``path`` (rotated captures).

    A file must be complete when it appears (write elsewhere, then move). Files of a trigger are read in
    splits as by :func:`read_captures`, by as many tasks as there are shuffle partitions; a trigger that fails is read again as a whole.
    """
    landing = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _read_files(landing.select("path", "length"), split_bytes, ports, tasks)


class _OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


PORT_FIELDS = ["src_port", "dst_port"]


class _CaptureReader(DataSourceReader):
    def __init__(self, path: str, ports: frozenset[int]):
        from pyarrow import fs

        local = path if "://" in path else "file:///" + path.removeprefix("file:").lstrip("/")
        system, name = fs.FileSystem.from_uri(local)
        info = system.get_file_info(name)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(name, recursive=True))
        prefix = local.split("://")[0] + "://"
        self.paths = sorted(prefix + f.path for f in found if f.is_file)
        self.ports = ports
        self.sides: list[frozenset[int] | None] = [None, None]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take the port conditions; rows are read, and left out, by them."""
        for f in filters:
            side = PORT_FIELDS.index(f.attribute[0]) if getattr(f, "attribute", (None,))[0] in PORT_FIELDS else None
            if side is None or not isinstance(f, (EqualTo, In)):
                yield f
                continue
            values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            self.sides[side] = values if self.sides[side] is None else self.sides[side] & values

    def partitions(self) -> list[InputPartition]:
        return [_OneFile(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        asked = bool(self.ports) or self.sides != [None, None]
        wanted = on_ports(self.ports, *self.sides) if asked else None
        with open_capture(partition.path) as capture:
            for batch in _batches(capture, 0, 1 << 62, Section(), wanted):
                both = tcp_ports(batch.column(RAW_SCHEMA.names.index("data")))
                batch = pa.RecordBatch.from_arrays([*batch.columns, *both], [*RAW_SCHEMA.names, *PORT_FIELDS])
                if asked:  # the heads alone do not tell of every frame
                    batch = batch.filter(self._kept(*both))
                yield batch

    def _kept(self, src: pa.Array, dst: pa.Array) -> pa.Array:
        def one(a: int | None, b: int | None) -> bool:
            if a is None:
                return False
            sides = [s is None or p in s for s, p in zip(self.sides, (a, b))]
            return all(sides) and (not self.ports or a in self.ports or b in self.ports)

        return pa.array([one(a, b) for a, b in zip(src.to_pylist(), dst.to_pylist())], pa.bool_())


class CaptureSource(DataSource):
    """``spark.read.format("pcap").load(path)``: one task per file; for rotated captures.

    Has the columns ``src_port`` and ``dst_port`` besides those of a raw packet, null where a frame is no TCP.
    Conditions on them (``=``, ``IN``) are pushed into the reader; option ``ports`` keeps packets with one of
    them on either side. Payloads of packets that are left out are seeked over.
    """

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> T.StructType:
        return T.StructType(RAW_SCHEMA.fields + [T.StructField(n, T.IntegerType()) for n in PORT_FIELDS])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        ports = [int(p) for p in self.options.get("ports", "").split(",") if p.strip()]
        return _CaptureReader(path, frozenset(check_ports(ports) if ports else ()))


def register_pcap(spark: SparkSession) -> None:
    """Make the ``pcap`` format known to a session, and let conditions reach readers of such formats.

    Spark refuses a reader that takes conditions while ``spark.sql.python.filterPushdown.enabled`` is off.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(CaptureSource)
