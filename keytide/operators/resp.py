"""RESP values on tables: one encoded value per row in, one row per leaf out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keytide.functions.protocols import Bad, Short, resp_value

# Fixed value: arrays a value may be nested in.
MAX_ARRAYS = 6
#: Leaves, and bytes of their texts, that are put out at a time.
BATCH_LEAVES, BATCH_BYTES = 4096, 4 << 20


def leaves(data: bytes, capture: int) -> Iterator[tuple]:
    """``(path, tag, text, number, length)`` of each leaf of the first value in ``data``.

    A leaf is a value that is not an array, or an empty array.  Reading stops with tag ``short``
    where the data ends early and ``bad`` where it is not RESP or nests too deep.
    """
    at, path, counts = 0, [], []
    while True:
        try:
            if len(path) > MAX_ARRAYS:
                raise Bad
            value = resp_value(data, at, capture)
            if value.kind == "bulk" and len(data) < value.next:
                raise Short
        except (Short, Bad) as stop:
            tag = "short" if isinstance(stop, Short) else "bad"
            yield list(path), tag, None, None, None
            return
        at = value.next
        if value.kind == "array" and value.size:
            path.append(0)
            counts.append(value.size)
            continue
        text = value.key
        number = value.size if value.kind == "int" else None
        length = value.size if value.kind in ("bulk", "array") else None
        yield list(path), value.kind, text, number, length
        while path and path[-1] + 1 == counts[-1]:
            path.pop()
            counts.pop()
        if not path:
            return
        path[-1] += 1


def decode_resp(df: DataFrame, payload: str = "payload", capture: int = 0) -> DataFrame:
    """Decode one RESP value per row to leaves; the other columns are repeated.

    Adds ``path`` (positions in the enclosing arrays), ``depth``, ``tag`` (``status``, ``error``,
    ``int``, ``bulk``, ``nil``, ``array`` if empty, ``short``, ``bad``), ``bytes`` (status and error
    texts, and bulk strings up to ``capture`` bytes), ``number`` and ``length``.
    """
    kept = [f for f in df.schema.fields if f.name != payload]
    names = [f.name for f in kept]
    schema = T.StructType(
        [
            *kept,
            T.StructField("path", T.ArrayType(T.IntegerType())),
            T.StructField("depth", T.IntegerType()),
            T.StructField("tag", T.StringType()),
            T.StructField("bytes", T.BinaryType()),
            T.StructField("number", T.LongType()),
            T.StructField("length", T.LongType()),
        ]
    )

    types = to_arrow_schema(T.StructType(schema.fields[len(kept) :]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at, size = [], [], 0
            for i, data in enumerate(batch.column(0)):
                for path, tag, text, number, length in leaves(data.as_py(), capture):
                    found.append((path, len(path), tag, text, number, length))
                    at.append(i)
                    size += len(text or b"")
                if len(found) >= BATCH_LEAVES or size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    rest = [c.take(pa.array(at, pa.int64())) for c in batch.columns[1:]]
                    made = [pa.array(c, f.type) for c, f in zip(zip(*found), types)]
                    yield pa.RecordBatch.from_arrays([*rest, *made], names=schema.names)
                    found, at, size = [], [], 0

    return df.select(payload, *names).mapInArrow(decode, schema)
