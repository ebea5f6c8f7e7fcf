"""Words, word hashes and shingles of whole Arrow string columns, vectorised over the UTF-8 bytes.

A word is a maximal run of bytes outside a separator set; all separators are ASCII, so bytes and code
points agree on where words stand. Texts are never cut: a long text is hashed in sections that end at
separators, so memory stays at a small multiple of the section and of the word count.

A word's hash is mixed from its bytes eight at a time. Its constants are public, so words that collide can be made on
purpose; where a hash decides alone, ``keyed`` mixes in a secret that the driver draws anew, which no text can have been
made for. Elsewhere the bytes are compared, or words may share a place.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import suppress
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Bytes of a section of a text, and of the texts that are worked on at a time.
SECTION = 1 << 19
SLICE = 1 << 20
SHINGLE = 5

#: True for bytes of words `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: True for bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM[_low : _high + 1] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240501))
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
#: Keeps the first 0 to 8 bytes of a little-endian 64-bit integer.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes up to which words are hashed side by side, eight bytes a step.
_LONG = 256


class Words(NamedTuple):
    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    check: np.ndarray  # a second hash, independent of the first


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer: spreads the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n+1 offsets of texts in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes, one row at least."""
    _, offsets = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _section_end(data: np.ndarray, at: int, word: np.ndarray) -> int:
    end = at + SECTION
    while end < len(data):
        gaps = np.flatnonzero(~word[data[max(at, end - SECTION) : end]])
        if len(gaps):
            return max(at, end - SECTION) + int(gaps[-1]) + 1
        end += SECTION
    return len(data)


_secret: bytes | None = None


def secret() -> bytes:
    """The key of keyed hashes: drawn by the driver, brought to tasks by ``lean``."""
    global _secret
    if _secret is None:
        if TaskContext.get() is not None:
            raise RuntimeError("keyed hashes need a batch function that lean has wrapped")
        _secret = os.urandom(16)
    return _secret


def _hashes(part: np.ndarray, start: np.ndarray, end: np.ndarray, key: bytes = bytes(16)) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word: eight bytes a step are mixed in."""
    first, second = np.frombuffer(key, np.uint64)
    by_one, by_two = _SECOND ^ (first << np.uint64(1)), _FIRST ^ (second << np.uint64(1))
    padded = np.concatenate([part, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(part) + 1,), np.dtype("<u8"), buffer=padded.data, strides=(1,))
    left = end - start
    one = left.astype(np.uint64) * _FIRST ^ first
    two = one ^ _SECOND ^ second
    at, own = start, np.arange(len(start))
    long = np.flatnonzero(left > _LONG)
    for i in long.tolist():
        one[i], two[i] = np.frombuffer(blake2b(part[start[i] : end[i]].tobytes(), digest_size=16, key=key if any(key) else b"").digest(), np.uint64)
    if len(long):
        own = np.flatnonzero(left <= _LONG)
        at, left = at[own], left[own]
    while len(own):
        c = eight[at] & _KEEP[np.minimum(left, 8)]
        one[own], two[own] = mixed(one[own] ^ (c * by_one)), mixed(two[own] + c * by_two)
        more = np.flatnonzero(left > 8)
        own, at, left = own[more], at[more] + 8, left[more] - 8
    return one, two


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACED, lower: bool = True, keyed: bool = False, key: bytes = bytes(16)) -> Words:
    """Every word (of the text in lower case, if wanted): 64-bit hash, index of its text, first byte and end byte
    in ``data``, and a second hash. keyed: hashes that differ from run to run; else ``key`` (16 bytes) is mixed in."""
    key = secret() if keyed else key
    if lower:
        word = word[LOWER]
    hashes, checks, starts, ends = [], [], [], []
    at = 0
    cuts = np.unique(offsets)
    while at < len(data):
        to = _section_end(data, at, word)
        part = data[at:to]
        inside = word[part]
        edge = np.zeros(len(part) + 1, bool)
        low, high = np.searchsorted(cuts, [at, to + 1])
        edge[cuts[low:high] - at] = True
        edge[0] = edge[-1] = True
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        s = np.flatnonzero(inside & (~before | edge[:-1]))
        e = np.flatnonzero(inside & (~after | edge[1:])) + 1
        one, two = _hashes(LOWER[part] if lower else part, s, e, key)
        hashes.append(one)
        checks.append(two)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not hashes:
        none, zero = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Words(zero, none, none, none, zero)
    start = np.concatenate(starts)
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(np.concatenate(hashes), doc, start, np.concatenate(ends), np.concatenate(checks))


def windows(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``size`` words, in their order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _MIX[0]
    for j in range(1, size):
        out += hashes[j : j + n] * _MIX[j]
    return mixed(out)


def shingles(w: Words, n_docs: int, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles; a text of fewer words has its whole sequence as one."""
    bounds = np.searchsorted(w.doc, np.arange(n_docs + 1))
    every = windows(w.hash, size)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            yield windows(np.append(w.hash[a:b], np.uint64(b - a)), b - a + 1)
        else:
            yield np.zeros(0, np.uint64)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The batch function, giving free memory back to the system when it ends: Python workers live on for later
    stages, beside a full heap of the executor. Brings the key of keyed hashes along."""
    key = secret()

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from slideqa.llm import text

        text._secret = key
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def points(data: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte: turns byte offsets into code point offsets."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
