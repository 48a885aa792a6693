"""WARC archives: writing them from pages, and reading them by boundary-chain verification.

Archives are plain text files to Spark: its text writer ends every record, and its text reader, with the
record magic as line separator, hands out what lies between two magics, in splits of any file. Such a piece
need not be a record: payloads may hold the magic, or whole records. So

1. tasks parse each piece as if a record began there and emit its offset and that of the successor its
   length implies (offsets count from the split; the splits' sizes add up to those in the file);
2. within each split, pointer jumping finds for every candidate where its chain leaves the split;
3. across splits, pointer jumping over these few exits, from the start of each file, finds the entry of
   each split that is really reached;
4. within each split, the records on the chain from its entry are kept. Pieces between them belong to
   the payload of the record before.

Payloads in one piece are digested where they are read and never move; only those that hold the magic are
put together from their pieces.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytide.llm.common import stage
from keytide.plans.cut import shared_folder

MAGIC = "WARC/1.0\r\n"
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Repeated payloads up to which their table goes to all tasks; beyond, pages are shuffled by digest.
SENT_ROWS = 200_000

#: Fixed value of the revisit profile that the format defines.
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.MULTILINE)


def records(pages: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """``value``: one record per page, without the line end that closes it."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("id"),
        # Blanks and control characters, which would break the header, are percent-encoded.
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("uri"),
        payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).alias("size"),
    )
    large = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size")
    repeated = large.agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = stage(repeated, "repeated")
    few = repeated.count() <= SENT_ROWS
    rows = rows.join(F.broadcast(repeated) if few else repeated, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def page(column: str):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))

    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", page("id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
    )
    response = F.concat(line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("size").cast("string")))
    refers = F.concat(
        line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", page("first")), line("Content-Length", F.lit("0"))
    )
    body = F.when(revisit, F.concat(refers, F.lit("\r\n"))).otherwise(F.concat(response, F.lit("\r\n"), F.col("payload")))
    return rows.select(F.concat(head, body, F.lit("\r\n")).alias("value"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write a record per page below ``folder``.

    Of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the largest ``page_id`` is a
    response and the others revisits of it (rows that repeat that id are responses too); smaller payloads
    are all responses. A null html is an empty payload, a null url an empty one, a null id an empty name,
    smaller than all others.
    """
    records(pages).write.option("lineSep", "\r\n").text(folder)


def _parse(piece: bytes) -> tuple[int | None, dict[bytes, bytes], int]:
    """Size of the record that starts before ``piece``, its fields, and where its payload begins."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None, {}, 0
    fields = {k.lower(): v.strip() for k, v in _FIELD.findall(piece[: end + 2].replace(b"\r\n", b"\n"))}
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return None, fields, end + 4
    return len(MAGIC) + end + 4 + int(length) + 4, fields, end + 4


def _number(fields: dict[bytes, bytes], name: bytes) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?[0-9]+)>", fields.get(name, b""))
    return int(found[1]) if found else None


_PIECES = (
    "file string, block long, rel long, size long, record long, kind string, id long, refers long, "
    "digest string, length long, payload_at long, body binary"
)


def _pieces(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """Every piece between two magics: its place in its split, and the record it would start.

    Only pieces that are no complete record carry their bytes, or all if ``whole``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rel, names = None, 0, [f.split()[0] for f in _PIECES.split(", ")]
        for batch in batches:
            rows = []
            for file, block, piece in zip(*(c.to_pylist() for c in batch.columns)):
                piece = piece or b""
                if here != (file, block):
                    here, rel = (file, block), 0
                size = len(piece) + len(MAGIC)
                if block == 0 and rel == 0:
                    # What precedes the first magic, nothing if the file starts with a record.
                    rows.append((file, block, rel, size, None, None, None, None, None, None, 0, None))
                    rel += size
                    continue
                record, fields, at = _parse(piece)
                kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
                digest, length, body = fields.get(b"warc-payload-digest", b"")[5:].decode("utf-8", "replace"), None, None
                if kind == "revisit":
                    length = int(fields.get(b"warc-payload-length", b"0") or 0)
                elif record == size:
                    payload = piece[at:-4]
                    digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
                if whole or record != size:
                    body = piece
                rows.append(
                    (file, block, rel, size, record, kind, _number(fields, b"warc-record-id"), _number(fields, b"warc-refers-to"), digest, length, at, body)
                )
                rel += size
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    lines = spark.read.option("lineSep", MAGIC).text(folder)
    lines = lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    return lines.mapInArrow(run, _PIECES)


def _jump(succ: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each candidate's successor among the sorted ``offsets``; itself if that is not there."""
    at = np.minimum(np.searchsorted(offsets, succ), len(offsets) - 1)
    return np.where(offsets[at] == succ, at, np.arange(len(offsets)))


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a split leaves it."""
    group = group.sort_values("off")
    off, succ = group["off"].to_numpy(), group["succ"].to_numpy()
    last = _jump(succ, off)
    while not np.array_equal(last, last[last]):
        last = last[last]
    return pd.DataFrame({"file": group["file"], "off": off, "exit": succ[last]})


def _reached(group: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split on the chain from its entry, and for the others the record before."""
    group = group.sort_values("off")
    off = group["off"].to_numpy()
    jump, on = _jump(group["succ"].to_numpy(), off), off == group["entry"].to_numpy()
    while True:
        more = on.copy()
        more[jump[on]] = True
        if np.array_equal(more, on):
            break
        on, jump = more, jump[jump]
    owner = np.maximum.accumulate(np.where(on, off, -1))
    return pd.DataFrame({"file": group["file"], "block": group["block"], "off": off, "owner": owner})


def _entries(candidates: DataFrame) -> DataFrame:
    """``file, block, entry``: where the chain from the start of each file enters each split."""
    jumps = candidates.groupBy("file", "block").applyInPandas(_exits, "file string, off long, exit long")
    jumps = stage(jumps, "jumps")
    targets = jumps.select("file", F.col("exit").alias("off")).union(jumps.select("file", F.lit(0).cast("long"))).distinct()
    nodes = stage(jumps.join(targets, ["file", "off"]), "nodes")
    reached = nodes.filter("off = 0").select("file", "off")
    while True:
        # Twice the steps each round: what is reached, and what the longer jumps reach from it.
        further = reached.join(nodes, ["file", "off"]).select("file", F.col("exit").alias("off"))
        grown = stage(reached.union(further.join(nodes.select("file", "off"), ["file", "off"])).distinct(), "reached")
        if grown.count() == reached.count():
            break
        reached = grown
        onward = nodes.select("file", F.col("off").alias("exit"), F.col("exit").alias("next"))
        nodes = stage(
            nodes.join(onward, ["file", "exit"], "left").select("file", "off", F.coalesce("next", "exit").alias("exit")),
            "nodes",
        )
    places = candidates.select("file", "block", "off").join(reached, ["file", "off"])
    return places.groupBy("file", "block").agg(F.min("off").alias("entry"))


def _joined(pieces: DataFrame) -> DataFrame:
    """Length and digest of the payloads that lie in several pieces."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("off")
        data = MAGIC.encode().join(group["body"])
        first = group.iloc[0]
        payload = data[int(first["payload_at"]) : int(first["record"]) - len(MAGIC) - 4]
        if len(payload) != int(first["record"]) - len(MAGIC) - 4 - int(first["payload_at"]):
            raise ValueError(f"pieces of the record at {first['owner']} of {first['file']} are missing")
        return pd.DataFrame(
            {
                "file": [first["file"]],
                "off": [first["owner"]],
                "length": [len(payload)],
                "digest": [hashlib.sha1(payload).hexdigest()],
            }
        )

    rows = pieces.select("file", "owner", "off", "body", "payload_at", "record")
    return rows.groupBy("file", "owner").applyInPandas(run, "file string, off long, length long, digest string")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records below ``folder``: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Payload sizes and digests are those of the payloads read; revisits repeat what their header says of the
    payload they refer to. Magics and records inside payloads are no records. A file that does not start
    with a record has none; a chain that ends at something else than a record ends there. An empty folder gives
    an empty result.
    """
    pieces = stage(_pieces(spark, folder), "pieces")
    sizes = pieces.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    # A piece starts after its magic.
    placed = pieces.join(base, ["file", "block"]).withColumn("off", F.col("base") + F.col("rel") - len(MAGIC))
    placed = placed.filter("off >= 0").drop("base").withColumn("succ", F.col("off") + F.col("record"))
    candidates = stage(placed.select("file", "block", "off", F.coalesce("succ", "off").alias("succ")), "candidates")
    entries = _entries(candidates)
    chain = candidates.join(entries, ["file", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(-1)))
    chain = chain.groupBy("file", "block").applyInPandas(_reached, "file string, block long, off long, owner long")
    chain = stage(chain, "chain")
    # A payload may reach into later splits: there the last record before owns the first pieces.
    last = chain.groupBy("file", "block").agg(F.max("owner").alias("last"))
    last = last.select("file", "block", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carried"))
    owned = chain.join(last, ["file", "block"]).select("file", "off", F.greatest("owner", "carried").alias("owner"))
    found = placed.join(owned, ["file", "off"])
    whole = found.filter("off = owner and record is not null")
    heads = whole.filter("body is not null").select("file", F.col("off").alias("owner"), F.col("succ").alias("stop"))
    inside = found.filter("owner >= 0").join(heads, ["file", "owner"]).filter("off < stop")
    inside = stage(inside.select("file", "block", "rel", "owner", "off", "body", "payload_at", "record"), "inside")
    split = inside.filter("body is not null")
    # Complete records inside payloads came without their bytes, which a second scan fetches.
    lacking = inside.filter("body is null").drop("body")
    if not lacking.isEmpty():
        bytes_ = _pieces(spark, folder, whole=True).select("file", "block", "rel", "body")
        split = split.unionByName(lacking.join(bytes_, ["file", "block", "rel"]))
    parts = _joined(split).select("file", "off", F.col("length").alias("l"), F.col("digest").alias("d"))
    return whole.drop("body", "rel").join(parts, ["file", "off"], "left").select(
        F.col("id").alias("page_id"),
        F.coalesce("l", "length").alias("payload_bytes"),
        F.coalesce("d", "digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers").alias("refers_to"),
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) to archives and read them back, a row per page.

    Nulls are as in ``write_archives``; empty and very long payloads are kept whole; repeated rows come
    back as often as they go in; an empty table gives an empty result; other columns are not looked at.
    """
    folder = archive_folder(pages.sparkSession)
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder)
