"""Batch encoding of texts whose ids are the concatenated ids of independent chunks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np


def gather(ids: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``at`` behind each other, and where each ends; entry ``i`` is ``ids[starts[i]:starts[i + 1]]``."""
    first = starts[at]
    n = starts[at + 1] - first
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(first - (ends - n), n) + np.arange(total)], ends


class Chunks:
    """Encodes a batch's distinct chunks only; about ``limit`` chunks are remembered between batches.

    ``split`` cuts a text into chunks, ``encode`` gives the ids of a list of chunks.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list], limit: int = 200_000):
        self.split, self.encode_new, self.limit = split, encode, limit
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids behind each other, and the number of ids per text."""
        if len(self.at) > self.limit:
            self._forget()
        split = [self.split(t) for t in texts]
        flat = [x for words in split for x in words]
        new = list(set(flat).difference(self.at))
        if new:
            found = self.encode_new(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + len(self.ids)
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), np.uint32)))
            self.starts = np.concatenate((self.starts, ends))
        at = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        ids, ends = gather(self.ids, self.starts, at)
        upto = np.concatenate(([0], ends))[np.cumsum([0, *map(len, split)])]
        return ids, np.diff(upto)
