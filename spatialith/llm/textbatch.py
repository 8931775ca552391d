"""Whole texts as flat arrays: code points, words, word hashes and shingle sets, without loops over characters.

A chunk of texts is one array of code points with an offset per text.  Words are runs of anything but the six ASCII
white-space characters.  Hashes are 64-bit polynomial sums over mixed code points, finished by a bit mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of one chunk; a longer text is a chunk of its own.
CHUNK_CHARS = 1_000_000
SHINGLE_WORDS = 5
#: A shingle is 48 bits of hash; the 16 bits above hold the text's number within its chunk.
SHINGLE_BITS = 48
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: What a span's length adds to its hash before the last mixing.
LENGTH_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}
_POINT_SALT = np.uint64(0x632BE59BD9B4E019)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_M1_INV = np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
_M2_INV = np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix64``."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((31, _M2_INV), (27, _M1_INV), (30, np.uint64(1))):
        x ^= (x >> np.uint64(shift)) ^ (x >> np.uint64(2 * shift))
        x *= factor
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Base to the power 0..n-1 modulo 2^64, or the inverses."""
    key = "inverse" if inverse else "plain"
    if key not in _POWERS or len(_POWERS[key]) < n:
        steps = np.full(max(n, CHUNK_CHARS + 1), _BASE_INV if inverse else _BASE, np.uint64)
        steps[0] = 1
        _POWERS[key] = np.cumprod(steps)
    return _POWERS[key][:n]


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and len(texts) + 1 offsets.  None counts as empty."""
    return np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32), _offsets(texts)


def _offsets(texts: list[str | None]) -> np.ndarray:
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    return np.concatenate([[0], np.cumsum(lengths)])


def lowered_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``codes`` with A-Z lower-cased; one byte each if all are below 256, which takes a fraction of the time."""
    joined = "".join(t for t in texts if t)
    try:
        return np.frombuffer(joined.encode("latin-1").lower(), np.uint8), _offsets(texts)  # of bytes, A-Z alone are lowered
    except UnicodeEncodeError:
        flat, offsets = codes(texts)
        return lower_ascii(flat), offsets


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with at most ``limit`` characters and 2^16 texts together, one text at least."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and (size + n > limit or i - first >= 1 << 16):
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def text_chunks(column: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str | None]]]:
    """``chunks`` of a column with the texts of each, which alone are Python strings at a time."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    for first, end in chunks([range(n) for n in sizes.tolist()], limit):
        yield first, end, column.slice(first, end - first).to_pylist()


def give_back() -> None:
    """Returns what this process holds but doesn't use to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes that a process keeps once it has freed them, and of the largest array that it keeps.
KEPT, KEPT_ARRAY = 1 << 26, 1 << 25


def keep_freed() -> None:
    """Lets this process use memory again that it freed: passing each array back to the system has its pages cleared anew."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option:
        option(-3, KEPT_ARRAY)  # M_MMAP_THRESHOLD
        option(-1, KEPT)  # M_TRIM_THRESHOLD


def tidy(run: Callable) -> Callable:
    """``run``, a map over batches, that gives memory back at the end of a task.

    Workers outlive their tasks, and stand beside later stages of the same executor, the heap's growth included.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def lower_ascii(flat: np.ndarray) -> np.ndarray:
    return np.where((flat >= 65) & (flat <= 90), flat + np.uint32(32), flat)


def is_space(flat: np.ndarray) -> np.ndarray:
    return (flat == 32) | ((flat >= 9) & (flat <= 13))


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words end at or before each text offset (len(texts) + 1)."""
    inside = ~is_space(flat)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(flat))]
    first[cuts] |= inside[cuts]  # a text's end also ends a word
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POINTS = mix64(np.arange(1 << 16, dtype=np.uint64) + _POINT_SALT)


def mixed_points(flat: np.ndarray) -> np.ndarray:
    """Mixed code points; those of the first plane from a table."""
    out = _POINTS.take(flat, mode="clip")
    if flat.dtype.itemsize == 1:
        return out
    far = np.flatnonzero(flat >= len(_POINTS))
    out[far] = mix64(flat[far].astype(np.uint64) + _POINT_SALT)
    return out


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points."""
    terms = mixed_points(flat)
    terms *= powers(len(flat))
    sums = np.empty(len(flat) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(len(flat) + 1, inverse=True)[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * LENGTH_FACTOR)


class Places:
    """Sorted 64-bit hashes, and where those with the same leading bits start: hashes are spread evenly."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.shift = np.uint64(64 - bits)
        starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.bucket = starts.astype(np.int32)
        self.ceiling = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        at = self.bucket[keys >> self.shift]
        here = self.ceiling[at]
        out = np.where(here == keys, at, np.int32(-1))
        todo = np.flatnonzero(here < keys)  # behind others of its bucket
        while len(todo):
            at[todo] += 1
            here = self.ceiling[at[todo]]
            same = here == keys[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[here < keys[todo]]
        out[out == len(self.ceiling) - 1] = -1  # the end is no key
        return out


def shingles(texts: list[str | None], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and len(texts) + 1 offsets.

    Words are lower-cased (A-Z).  A text of fewer than ``size`` words has one shingle, all its words; a text without
    words has none.  One chunk of texts at a time (see ``chunks``).
    """
    flat, offsets = codes(texts)
    flat = lower_ascii(flat)
    starts, ends, at = words(flat, offsets)
    h = span_hashes(flat, starts, ends)
    text_of = np.repeat(np.arange(len(texts)), np.diff(at))
    full = len(h) - size + 1
    parts = []
    if full > 0:
        one = np.flatnonzero(text_of[:full] == text_of[size - 1 :])
        value = np.zeros(len(one), np.uint64)
        for k in range(size):
            value += h[one + k] * np.uint64(2 * (k + 1) * 0x5851F42D4C957F2D + 1 & (1 << 64) - 1)
        parts.append((text_of[one], mix64(value)))
    n_words = np.diff(at)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = n_words[short] > k
            value[more] += h[at[short[more]] + k] * np.uint64(2 * (k + 1) * 0x5851F42D4C957F2D + 1 & (1 << 64) - 1)
        parts.append((short, mix64(value + np.uint64(0xA0761D6478BD642F) * n_words[short].astype(np.uint64))))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    keys = [(t.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | (v >> np.uint64(64 - SHINGLE_BITS)) for t, v in parts]
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    edges = np.searchsorted(keys, np.arange(len(texts), dtype=np.uint64) << np.uint64(SHINGLE_BITS))
    return keys & np.uint64((1 << SHINGLE_BITS) - 1), np.concatenate([edges, [len(keys)]])
