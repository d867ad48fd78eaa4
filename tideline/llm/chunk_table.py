"""A table of distinct chunks: each is turned into token ids once, texts are joined from it.

Segmentation is the costly step of a tokenizer, and it never looks across a chunk's
border, so each worker process keeps, from task to task, the ids of the chunks that it has met. A table with over
``bound`` chunks is set aside for a new one, which takes over from it what is met again, and
the one before is dropped: memory stays bounded, results don't depend on it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable

Segment = Callable[[list[str]], list[bytes]]  # ids of each chunk, four little-endian bytes each


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_KEPT: dict = {}


def once_per_worker(key, make: Callable):
    """What ``make`` made for the key, once in a worker process and not once in a task; another key's is dropped.

    Task functions are sent with their globals by value, but find this function by its name, so they share it.
    """
    if _KEPT.get("key") != key:
        _KEPT.update(key=None, value=None)
        _KEPT.update(value=make(), key=key)
    return _KEPT["value"]


class ChunkTable:
    def __init__(self, segment: Segment, bound: int = 200_000):
        self.segment = segment
        self.bound = bound
        self.ids: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}

    def learn(self, chunked: Iterable[list[str]]) -> list[str]:
        """Add the chunks that are new; returns those that had to be segmented."""
        if len(self.ids) > self.bound:
            self.aside, self.ids = self.ids, {}
        new = set().union(*chunked).difference(self.ids)
        again = new.intersection(self.aside)
        self.ids.update((chunk, self.aside[chunk]) for chunk in again)
        new = list(new - again)
        if new:
            self.ids.update(zip(new, self.segment(new), strict=True))
        return new

    def joined(self, chunks: list[str]) -> bytes:
        """The ids of the chunks in order."""
        return b"".join(map(self.ids.__getitem__, chunks))
