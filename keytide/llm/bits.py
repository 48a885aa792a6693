"""Tables that tell in every task which 64-bit values may be in a set, made on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import tidy

#: Slots of a table: so many times the values in it, from 2 to the 16 up to 2 to the 30 (128 MiB).
SLOTS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 30
_PARTS = 6


@dataclass(frozen=True)
class BitTable:
    """One bit for each slot, by the leading bits of a value; the table grows with its values, up to its bound."""

    bits: int
    packed: np.ndarray

    @staticmethod
    def of(values: DataFrame, column: str) -> BitTable:
        """The table of values that come once each; repeated ones make it larger, not wrong."""
        values = values.select(F.col(column).alias("v"))
        bits = min(MOST_BITS, max(LEAST_BITS, int(values.count() * SLOTS_EACH).bit_length()))
        low = bits - _PARTS
        slots = values.select(F.shiftrightunsigned("v", 64 - bits).alias("slot"))
        slots = slots.repartition(1 << _PARTS, F.shiftright("slot", low))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for batch in batches:
                found = batch.column(0).to_numpy()
                for part in np.unique(found >> low).tolist():
                    taken = parts.setdefault(part, np.zeros(1 << low, bool))
                    taken[found[found >> low == part] & ((1 << low) - 1)] = True
            packed = [np.packbits(b, bitorder="little").tobytes() for b in parts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array(packed, pa.binary())], ["part", "bits"])

        table = np.zeros((1 << _PARTS, (1 << low) // 8), np.uint8)
        for row in slots.mapInArrow(tidy(run), "part long, bits binary").toLocalIterator():
            table[row["part"]] |= np.frombuffer(row["bits"], np.uint8)
        return BitTable(bits, table.ravel())

    def taken(self, values: np.ndarray) -> np.ndarray:
        """Whether each value's slot is taken; true for all values in the set, and for few others."""
        slot = values >> np.uint64(64 - self.bits)
        at = (slot >> np.uint64(3)).astype(np.int64)
        return (self.packed[at] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
