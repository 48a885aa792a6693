"""Messages of reassembled streams, read in parallel from chunks of each stream.

A stream is cut into chunks of equal length; a chunk also sees a little of the next one, so headers
that straddle the border can be read.  Where the first message of a chunk starts depends on all
chunks before it.  Therefore each chunk first reports, for every place a message could start, where
the reading would leave it; following those short reports chunk by chunk gives every chunk its true
entry, and a second pass emits the messages.  A connection with a third of all bytes is thus read by
as many tasks as it has chunks.  Streams of a single chunk skip the first pass.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.functions.protocols import (
    BINARY_FIRST_BYTE,
    INFER,
    LINE_LIMIT,
    MCBINARY,
    MCTEXT,
    REDIS,
    REDIS_FIRST_BYTE,
    Bad,
    Message,
    Protocol,
    Short,
    Step,
    check_protocol,
    protocols,
)

CHUNK_BYTES = 4 << 20

_STREAM = ["flow", "from_server", "protocol"]
_CHUNK = [*_STREAM, "chunk"]
#: Without the protocol: Spark puts a protocol that is the same for all connections into expressions as a literal, and rows
#: dealt by a literal are not where a join by the column looks for them.
_GROUP = ["flow", "from_server", "group"]
_PIECES = [*_CHUNK, "start", "bytes", "us", "stream_len"]
_LINK_SCHEMA = (
    "flow string, from_server boolean, protocol string, chunk long, upto array<long>, leave array<long>"
)
_ENTRY_SCHEMA = "flow string, from_server boolean, protocol string, chunk long, entry long"
MESSAGE_SCHEMA = (
    "flow string, from_server boolean, protocol string, chunk long, pos long, kind string, "
    "mark boolean, unit boolean, delta long, key string, size long, us long"
)


class View:
    """The bytes of one chunk with a margin on both sides: runs without gaps, and segment starts."""

    def __init__(self, rows: list[tuple], limit: int):
        """``rows`` are ``(start, bytes, time, …)`` in stream order."""
        self.limit = limit
        self.starts = [r[0] for r in rows]
        self.times = [r[2] for r in rows]
        self.runs: list[int] = []
        parts: list[list[bytes]] = []
        end = None
        for start, data, *_ in rows:
            if start != end:
                self.runs.append(start)
                parts.append([])
            parts[-1].append(data)
            end = start + len(data)
        self.data = [b"".join(p) for p in parts]

    def time(self, pos: int) -> int:
        return self.times[max(bisect_right(self.starts, pos) - 1, 0)]

    def next_segment(self, pos: int, otherwise: int) -> int:
        i = bisect_left(self.starts, pos)
        return self.starts[i] if i < len(self.starts) else otherwise

    def advance(self, step: Step, pos: int) -> tuple[Message | str | None, int, int] | None:
        """Message, mark (``loss``, ``error``, ``overflow``) or nothing at ``pos``.

        Returns it with the place reading goes on and the place that decides its time, or None at
        the end of what is known.
        """
        i = bisect_right(self.runs, pos) - 1
        if i < 0 or pos >= self.runs[i] + len(self.data[i]):
            if i + 1 == len(self.runs):
                return None
            return "loss", self.runs[i + 1], self.runs[i + 1]
        base, data = self.runs[i], self.data[i]
        at, end = pos - base, base + len(data)
        if at and data[at - 1] != 10 and pos != self.next_segment(pos, end):
            newline = data.find(b"\n", at)
            after = base + newline + 1 if newline >= 0 else end
            return "error", min(after, self.next_segment(pos + 1, end)), pos
        try:
            message = step(data, at)
        except Short:
            message = None
        except Bad:
            return "error", min(self.next_segment(pos + 1, end), end), pos
        if (message.end if message else len(data)) - at > self.limit:
            dropped = min(pos + self.limit, end)
            return "overflow", min(self.next_segment(dropped, end), end), dropped - 1
        if message is None:
            return None, end, pos
        return message, base + message.next, base + message.end - 1

    def openings(self, low: int, high: int) -> list[int]:
        """Places in ``[low, high)`` where a message may start: after a line end or at a segment."""
        found = {s for s in self.starts if low <= s < high}
        for base, data in zip(self.runs, self.data):
            at = data.find(b"\n", max(low - base - 1, 0))
            while 0 <= at and base + at + 1 < high:
                if base + at + 1 >= low:
                    found.add(base + at + 1)
                at = data.find(b"\n", at + 1)
        return sorted(found)


def ways_through(view: View, step: Step, low: int, high: int) -> tuple[list[int], list[int]]:
    """For every opening of a chunk, where reading from there leaves the chunk.

    Neighbouring openings that leave at the same place are one entry ``(upto, leave)``; readings
    nearly always fall into step within a few messages, so a chunk has few entries.
    """
    leave: dict[int, int] = {}
    openings = view.openings(low, high)
    for opening in reversed(openings):
        pos = opening
        while pos < high and (pos == opening or pos not in leave):
            step_taken = view.advance(step, pos)
            if step_taken is None:
                break
            pos = step_taken[1]
        leave[opening] = leave.get(pos, pos) if pos != opening else pos
    upto, out = [], []
    for opening in openings:
        if out and out[-1] == leave[opening]:
            upto[-1] = opening
        else:
            upto.append(opening)
            out.append(leave[opening])
    return upto, out


def messages_in(view: View, step: Step, low: int, high: int, entry: int) -> Iterator[tuple]:
    """Messages and marks that start in a chunk entered at ``entry``, as message columns."""
    pos = entry
    if entry < low and view.starts:
        # Nothing is known of the place the last reading stopped at: go on at the next opening.
        openings = view.openings(low, high)
        if not openings:
            return
        pos = openings[0]
        yield (pos, "loss", True, False, None, None, None, view.time(pos))
    while pos < high:
        taken = view.advance(step, pos)
        if taken is None:
            return
        found, after, decided = taken
        if isinstance(found, str):
            yield (pos, found, True, False, None, None, None, view.time(decided))
        elif found is not None:
            key = None if found.key is None else found.key.decode("utf-8", "replace")
            yield (
                pos, found.kind, False, found.unit, found.delta, key, found.size,
                view.time(decided),
            )
        pos = after


def chosen_protocol(client_byte: Column, protocol: str = INFER) -> Column:
    """Protocol of a connection from the first byte its client sent.

    ``infer`` tells Redis by ``*``; anything else is memcached text, unless it starts with the
    magic byte of the binary protocol, which is not read at all.
    """
    if check_protocol(protocol) not in (INFER, MCTEXT):
        return F.lit(protocol)
    binary = F.when(client_byte == BINARY_FIRST_BYTE, MCBINARY)
    if protocol == INFER:
        binary = binary.when(client_byte == REDIS_FIRST_BYTE, REDIS)
    return binary.when(client_byte.isNotNull(), MCTEXT)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows of one chunk: its key, and its segments with what else the rows have."""
    rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
    for key, group in groupby(rows, key=lambda r: r[:4]):
        yield key, [row[4:] for row in group]


def _batched(rows: Iterator[tuple], columns: list[str], size: int = 4096) -> Iterator[pd.DataFrame]:
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == size:
            yield pd.DataFrame(batch, columns=columns, dtype=object)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=columns, dtype=object)


def _names(schema: str) -> list[str]:
    return [field.strip().split(" ")[0] for field in schema.split(", ")]


def _step_of(steps: dict[str, Protocol], key: tuple) -> Step:
    return steps[key[2]].reply if key[1] else steps[key[2]].request


def read_messages(
    segments: DataFrame, chunk_bytes: int = CHUNK_BYTES, line_limit: int = LINE_LIMIT
) -> DataFrame:
    """Messages of every stream from segments with ``bytes`` and a ``protocol`` column.

    The result has one row per message header, plus rows with ``mark`` set where bytes were lost,
    a line was longer than ``line_limit``, or the bytes were not a message; after a mark reading
    resumes at the next segment.
    """
    steps = protocols()
    known = segments.filter(F.col("protocol").isin(*steps))
    # Payloads go to their chunks once, for both readings, and neighbouring small chunks together: what a chunk sees of
    # the next one is then mostly there.
    together = F.lit(max(1, CHUNK_BYTES // chunk_bytes))
    placed = known.select(*_STREAM, F.col("rel_start").alias("start"), "bytes", F.col("ready").alias("us"), "stream_len")
    # A chunk sees one byte before its start and ``line_limit`` bytes past its end.
    first = F.floor(F.greatest(F.col("start") - line_limit, F.lit(0)) / chunk_bytes)
    last = F.floor((F.col("start") + F.octet_length("bytes")) / chunk_bytes)
    groups = F.explode(F.sequence(F.floor(first / together), F.floor(last / together)))
    dealt = placed.select("*", groups.alias("group")).repartition(*_GROUP)
    low, high = F.greatest(first, F.col("group") * together), F.least(last, (F.col("group") + 1) * together - 1)
    chunks = F.sequence(low, high)
    entries = _entries(dealt.withColumn("chunk", F.explode(chunks)), steps, chunk_bytes, line_limit)
    return _second_pass(dealt, chunks, entries, together, steps, chunk_bytes, line_limit)


def _in_order(pieces: DataFrame) -> DataFrame:
    # The hash leads the order because sorting compares it much faster than text.
    return pieces.sortWithinPartitions(F.xxhash64(*_CHUNK), *_CHUNK, "start")


def _entries(pieces: DataFrame, steps: dict, chunk_bytes: int, line_limit: int) -> DataFrame:
    # Only streams that touch several chunks need linking; one of just a chunk's length ends in the next. The condition
    # is on a value that is known after the shuffle only, as one that moved before it would make that another shuffle.
    known_here = F.when(F.spark_partition_id() >= 0, F.col("stream_len"))
    linked = pieces.filter(known_here >= chunk_bytes).select(*_PIECES)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for key, segments in _chunks(batches):
                low = key[3] * chunk_bytes
                view = View(segments, line_limit)
                ways = ways_through(view, _step_of(steps, key), low, low + chunk_bytes)
                yield (*key, *ways)

        yield from _batched(rows(), _names(_LINK_SCHEMA), 64)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            stream, pos = None, 0
            for batch in batches:
                for *key, upto, leave in batch.itertuples(index=False, name=None):
                    if key[:3] != stream:
                        stream, pos = key[:3], 0
                    yield (*key, pos)
                    i = bisect_left(upto, pos)
                    if pos < (key[3] + 1) * chunk_bytes and i < len(upto):
                        pos = int(leave[i])

        yield from _batched(rows(), _names(_ENTRY_SCHEMA))

    reports = _in_order(linked).mapInPandas(report, _LINK_SCHEMA)
    # One short row per chunk of a long stream: a 4 TB connection has a million of them.
    ordered = reports.repartition(*_STREAM).sortWithinPartitions(*_STREAM, "chunk")
    return ordered.mapInPandas(follow, _ENTRY_SCHEMA)


def _second_pass(
    dealt: DataFrame, chunks: Column, entries: DataFrame, together: Column, steps: dict, chunk_bytes: int, line_limit: int
) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for key, segments in _chunks(batches):
                low, entry = key[3] * chunk_bytes, segments[0][-1]
                view = View(segments, line_limit)
                step = _step_of(steps, key)
                for found in messages_in(view, step, low, low + chunk_bytes, int(entry)):
                    yield (*key, *found)

        yield from _batched(rows(), _names(MESSAGE_SCHEMA))

    # Entries are few beside the segments, which stay where they are: each task makes a table of the entries of its groups.
    grouped = entries.groupBy(*_STREAM, F.floor(F.col("chunk") / together).alias("group"))
    grouped = grouped.agg(F.map_from_entries(F.collect_list(F.struct("chunk", "entry"))).alias("entries"))
    grouped = grouped.groupBy(*_GROUP).agg(F.map_from_entries(F.collect_list(F.struct("protocol", "entries"))).alias("entries"))
    entered = dealt.join(grouped.hint("shuffle_hash"), _GROUP, "left")

    def entry(chunk: Column) -> Column:
        found = F.coalesce(F.element_at(F.element_at("entries", F.col("protocol")), chunk), F.lit(0).cast("long"))
        return F.struct(chunk.alias("chunk"), found.alias("entry"))

    pieces = entered.select(*dealt.columns, F.inline(F.transform(chunks, entry)))
    return _in_order(pieces.select(*_PIECES, "entry")).mapInPandas(read, MESSAGE_SCHEMA)
