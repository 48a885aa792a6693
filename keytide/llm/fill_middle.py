"""Fill-in-the-middle: a text cut at two places and put together with its middle last.

The places at which a text can be cut form a :class:`BoundarySet` over its bytes. A cut after k code
points is the k-th member: one search over containers, one select inside a container, no decoding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm.boundaries import BoundarySet
from keytide.llm.common import byte_texts, raw, slices

#: Marks before prefix, suffix and middle; a text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Transformed:
    form: str
    n: int
    prefix: int | None
    middle: int | None
    output: bytes


def drawn(doc_id: int | None, salt: str) -> list[int]:
    """Four numbers of 32 bits from the id (of a null id: from the salt)."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest, ">u4", 4).tolist()


def transform(text: bytes, numbers: list[int], percent: int, spm_percent: int) -> Transformed:
    """One text cut at the places that the numbers name, or left as it is."""
    places = BoundarySet(text)
    n = len(places) - 1
    first, second, rate, kind = numbers
    if not text or rate % 100 >= percent or any(m in text for m in _MARKS):
        return Transformed("plain", n, None, None, text)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    i, j = places.select(low), places.select(high)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    p, s, m = _MARKS
    if kind % 100 < spm_percent:
        return Transformed("spm", n, low, high - low, s + suffix + p + prefix + m + middle)
    return Transformed("psm", n, low, high - low, p + prefix + s + suffix + m + middle)


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 90,
    spm_percent: int = 20,
    salt: str = "1",
) -> DataFrame:
    """Every text in one of three forms, one row per input row.

    Columns: ``doc_id``, ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` and
    ``output``. Form ``psm`` is prefix, suffix, middle, ``spm`` suffix, prefix, middle, each behind its
    mark; ``plain`` is the text itself. ``percent`` of the texts are transformed, of those
    ``spm_percent`` to ``spm``; places and forms depend on the id alone (on ``salt`` alone, if it is
    null), so repeated rows come back alike.

    Null and empty texts are plain and empty, and so is a text with a mark in it plain. A text with
    bytes that are not UTF-8 is cut at bytes that start a code point. An empty table gives an empty
    result; other columns are not looked at. Tasks hold some MB of texts, or one text, at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(0).to_pylist()
                made = [
                    transform(t, drawn(i, salt), percent, spm_percent)
                    for i, t in zip(ids, byte_texts(part, "text"))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([m.n for m in made], pa.int64()),
                        pa.array([m.form for m in made], pa.string()),
                        pa.array([m.prefix for m in made], pa.int64()),
                        pa.array([m.middle for m in made], pa.int64()),
                        pa.array([m.output for m in made], pa.binary()).cast(pa.string()),
                    ],
                    [f.split()[0] for f in _SCHEMA.split(", ")],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), raw(text).alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def restored(form: Column, output: Column) -> Column:
    """The text from its output and form, by built-in functions.

    The text held no mark, and a part of one cannot make a mark with the mark that follows it, so the
    first mark found is the one that was put there.
    """
    first = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))  # the mark of the second part
    head = F.substring(output, 4, F.instr(output, first) - 4)
    rest = F.substring(output, F.instr(output, first) + 3, F.length(output))
    at = F.instr(rest, F.lit(MIDDLE))
    second, middle = F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + 3, F.length(rest))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(head, middle, second))
        .otherwise(F.concat(second, middle, head))
    )
