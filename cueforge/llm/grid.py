"""Byte-level views of Arrow text columns for vectorised passes: hashes of runs, words, shingles.

Everything works on the concatenated bytes of many texts and their offsets, so that no Python code runs per word.
Hashes of words mix eight bytes at a time. Those of every run of one width (Runs) come from prefix sums of byte values
times powers of an odd base, modulo 2**64: sound for the short runs they are used for, not for long ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a pass takes at once; a longer text is a piece by itself.
PIECE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BASES = (_BASE, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_values: dict[int, np.ndarray] = {}


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    col = col.fill_null("") if col.null_count else col
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(batch: pa.RecordBatch, text: int = 1, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of a batch's rows with their text bytes and offsets, each of about limit bytes at most."""
    if not batch.num_rows:
        return
    _, off = text_bytes(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
        part = batch.slice(start, stop - start)
        yield part, *text_bytes(part.column(text))
        start = stop


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads hashes over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _tables(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if kind not in _powers or len(_powers[kind][0]) < n:
        size = max(n, PIECE_BYTES + 65536)
        base = _BASES[kind]
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if kind not in _values:
        _values[kind] = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(kind << 32)) | np.uint64(1)
    return _powers[kind]


class Runs:
    """Hashes of any byte runs of buf. Two kinds with different bases make 128 bits."""

    def __init__(self, buf: np.ndarray, kind: int = 0):
        up, self.down = _tables(kind, len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_values[kind][buf] * up[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """The hash of the run of that width at each position."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes as they are."""
    return _LOWER[buf]


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, first word of each text and one past the last): words are runs without white space, within texts."""
    ink = ~_IS_SPACE[buf]
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    begins[inner] = ink[inner]
    ends[inner - 1] = ink[inner - 1]
    start, stop = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    return start, stop, np.searchsorted(start, off)


def counts(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many true entries each text has."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer runs are hashed one by one.
_LONG_RUN = 4096


def run_hashes(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hashes of byte runs, eight bytes a step, all bits mixed at each: no pattern in the bytes cancels out. Kinds are independent."""
    seed, odd = np.uint64(_BASES[kind] ^ 0x5555), np.uint64(_BASES[1 - kind])
    left = (stop - start).astype(np.int64)
    eights = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    h = mixed(left.astype(np.uint64) ^ seed)
    long = np.nonzero(left > _LONG_RUN)[0]
    live = np.nonzero((left > 0) & (left <= _LONG_RUN))[0]
    at, left = start[live], left[live]
    while len(live):
        part = eights[at] & _MASKS[np.minimum(left, 8)]
        with np.errstate(over="ignore"):
            h[live] = mixed(h[live] * odd + mixed(part ^ seed))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in long.tolist():
        digest = hashlib.blake2b(buf[start[i] : stop[i]].tobytes(), digest_size=16).digest()
        h[i] = np.frombuffer(digest, "<u8")[kind]
    return h


def shingle_hashes(buf: np.ndarray, off: np.ndarray, width: int = 5, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds per text) of the shingles of width words, repeats included; a text with fewer words has one of all its words, a text without words none."""
    low = lowered(buf)
    start, stop, first = word_bounds(low, off)
    words = run_hashes(low, start, stop, kind)
    n_words = np.diff(first)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(first[:-1], n)
    end = np.minimum(begin + width, np.repeat(first[1:], n))
    h = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            at = begin + k
            live = at < end
            step = h * np.uint64(_BASES[1 - kind]) + words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else h
            h = np.where(live, mixed(step), h)
    return h, bounds
