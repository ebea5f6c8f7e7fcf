"""Token ids of words, remembered in sorted arrays with the words' bytes: about 40 bytes a word."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from slideqa.llm.text import Words

#: Words that a worker remembers; beyond that it forgets all.
REMEMBERED = 2_000_000
#: Words that wait before they are merged into the large array.
RECENT = 100_000


class WordCache:
    """Words are looked up by hash and compared byte by byte, so two words never share an entry."""

    def __init__(self, encode: Callable[[list[bytes]], list], kind: type, limit: int = REMEMBERED):
        self.encode, self.kind, self.limit = encode, kind, limit
        self._clear()

    def _clear(self) -> None:
        # by ascending hash: the hash, place and number of the ids, place and length of the bytes
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.main, self.recent = empty, empty
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0
        self.bytes, self.bytes_used = np.zeros(1 << 16, np.uint8), 0

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    @staticmethod
    def _appended(pool: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(pool):
            pool = np.concatenate([pool, np.zeros(max(len(more), len(pool) // 2), pool.dtype)])
        pool[used : used + len(more)] = more
        return pool

    def _add(self, h: np.ndarray, got: list, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        sizes = np.fromiter(map(len, got), np.int32, len(got))
        ids = np.fromiter(chain.from_iterable(got), self.kind, int(sizes.sum()))
        text = data[ranges(starts, lengths)]
        self.pool, self.bytes = self._appended(self.pool, self.used, ids), self._appended(self.bytes, self.bytes_used, text)
        self.recent = self._merged(self.recent, (h, np.cumsum(sizes) - sizes + self.used, sizes, np.cumsum(lengths) - lengths + self.bytes_used, lengths.astype(np.int32)))
        self.used += len(ids)
        self.bytes_used += len(text)
        if len(self.recent[0]) > RECENT:
            self.main, self.recent = self._merged(self.main, self.recent), tuple(x[:0] for x in self.recent)

    def tokens(self, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the distinct words one after another, the number of each, and each word's place among them.
        data: the bytes that the words stand in."""
        if len(self.main[0]) + len(self.recent[0]) > self.limit:
            self._clear()
        h, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        lengths = w.end - w.start
        same = (w.check[first][which] == w.check) & (lengths[first][which] == lengths)
        if not same.all():
            return self._one_by_one(data, w)
        start, length = w.start[first], lengths[first]
        for attempt in range(2):
            starts, sizes, known = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            for keys, at, n, text, size in (self.main, self.recent):
                if len(keys):
                    p = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = np.flatnonzero(keys[p] == h)
                    p = p[hit]
                    if not equal_ranges(data, start[hit], length[hit], self.bytes, text[p], size[p]):
                        return self._one_by_one(data, w)
                    starts[hit], sizes[hit] = at[p], n[p]
                    known[hit] = True
            new = np.flatnonzero(~known)
            if attempt or not len(new):
                break
            found = [data[a : a + n].tobytes() for a, n in zip(start[new].tolist(), length[new].tolist(), strict=True)]
            self._add(h[new], self.encode(found), data, start[new], length[new])
        return self.pool[ranges(starts, sizes)], sizes, which

    def _one_by_one(self, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same without hashes, where two words share one."""
        places: dict[bytes, int] = {}
        which = [places.setdefault(data[a:b].tobytes(), len(places)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        got = self.encode(list(places))
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.kind, int(sizes.sum())), sizes, np.array(which, np.int64)


def equal_ranges(a: np.ndarray, at: np.ndarray, n: np.ndarray, b: np.ndarray, there: np.ndarray, m: np.ndarray) -> bool:
    """Whether a[at : at + n] equals b[there : there + m] for all of them."""
    return bool((n == m).all()) and bool((a[ranges(at, n)] == b[ranges(there, n)]).all())


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one range after another."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
