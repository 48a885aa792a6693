"""Sets of positions in containers of three kinds, with rank by container and select inside it.

Positions are split by their high bits into blocks of 65,536; a block is kept as the smallest of

* a run container: starts of runs and the members before each run;
* an array container: the members themselves;
* a bitmap container: 64-bit words and the members before each word.

The cardinalities of the blocks are summed up, so the k-th member is one search over blocks and one
select inside a block.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np

BLOCK = 1 << 16


@dataclass(frozen=True)
class RunContainer:
    starts: np.ndarray
    before: np.ndarray  # members before each run

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


@dataclass(frozen=True)
class ArrayContainer:
    members: np.ndarray

    def select(self, k: int) -> int:
        return int(self.members[k])


@dataclass(frozen=True)
class BitmapContainer:
    words: np.ndarray
    before: np.ndarray  # members before each word

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # drops the lowest member
        return 64 * at + (word & -word).bit_length() - 1


Container = RunContainer | ArrayContainer | BitmapContainer


def container_of(members: np.ndarray) -> Container:
    """The smallest container of a block's members, given as a mask over the block."""
    places = np.flatnonzero(members)
    if not len(places):
        return ArrayContainer(places.astype(np.uint16))
    edges = np.flatnonzero(np.diff(places) > 1) + 1
    firsts = np.concatenate([[0], edges])
    run_bytes, array_bytes, bitmap_bytes = 4 * len(firsts), 2 * len(places), BLOCK // 8
    if run_bytes <= min(array_bytes, bitmap_bytes):
        return RunContainer(places[firsts].astype(np.uint16), firsts.astype(np.int32))
    if array_bytes <= bitmap_bytes:
        return ArrayContainer(places.astype(np.uint16))
    padded = np.zeros(BLOCK, bool)
    padded[: len(members)] = members
    words = np.packbits(padded, bitorder="little").view("<u8")
    counts = np.bitwise_count(words).astype(np.int32)
    return BitmapContainer(words, np.cumsum(counts) - counts)


class BoundarySet:
    """Positions at which a UTF-8 text can be cut: the start of every code point, and the end."""

    def __init__(self, text: bytes):
        size = len(text) + 1
        blocks = -(-size // BLOCK)
        self.containers: list[Container] = []
        self.reach: list[int] = []  # members up to the end of each block
        ascii_only = text.isascii()
        total = 0
        for block in range(blocks):
            low, high = block * BLOCK, min(size, (block + 1) * BLOCK)
            if ascii_only:
                container: Container = RunContainer(np.zeros(1, np.uint16), np.zeros(1, np.int32))
                count = high - low
            else:
                members = (np.frombuffer(text, np.uint8, min(high, len(text)) - low, low) & 0xC0) != 0x80
                if high == size:
                    members = np.append(members, True)
                container, count = container_of(members), int(np.count_nonzero(members))
            total += count
            self.containers.append(container)
            self.reach.append(total)

    def __len__(self) -> int:
        return self.reach[-1]

    def select(self, k: int) -> int:
        """The k-th position, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        block = bisect_right(self.reach, k)
        return block * BLOCK + self.containers[block].select(k - (self.reach[block - 1] if block else 0))
