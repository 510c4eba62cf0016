"""Byte-level word splitting and hashing of Arrow text columns in numpy.

Words are runs of bytes other than x20 and x09-x0D. A word's hash is a
polynomial over random byte values modulo 2**64, mixed; A-Z count as a-z.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.default_rng(20240517)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
RAW_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER_VALUE = RAW_VALUE[LOWER]
_SHINGLE = _RNG.integers(1, 1 << 62, 8, dtype=np.uint64) * U(2) + U(1)
_STEP = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, _STEP + 1)
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row (one more than rows); null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def lean(f):
    """f over the batches of a task; what it freed goes back to the system, as workers live on for other tasks."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def pieces(batch: pa.RecordBatch, column: str, most: int = 6 << 20):
    """Slices of a batch with about `most` bytes of text each; a longer row stands alone."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; none crosses a row's end."""
    n = len(data)
    ns = NONSPACE[data] if inside is None else inside
    st, en = ns.copy(), ns.copy()
    if n:
        st[1:] &= ~ns[:-1]
        en[:-1] &= ~ns[1:]
        b = off[:-1][off[:-1] < n]
        st[b] = ns[b]
        e = off[1:][off[1:] > 0] - 1
        en[e] = ns[e]
    return np.flatnonzero(st), np.flatnonzero(en) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = LOWER_VALUE) -> np.ndarray:
    """Hash of each span of bytes; spans ascend and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _STEP, "right")))
        seg = data[lo : ends[j - 1]]
        pw, inv = _power(len(seg) + 1)
        p = np.zeros(len(seg) + 1, dtype=np.uint64)
        np.cumsum(value[seg] * pw[: len(seg)], out=p[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (p[e] - p[s]) * inv[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def row_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and each row's offset among them."""
    s, e = spans(data, off)
    return s, e, span_hashes(data, s, e), np.searchsorted(s, off)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words, whatever row they are in; len(h) - width + 1 values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, U(width), dtype=np.uint64)
    for k in range(width):
        out += h[k : k + n] * _SHINGLE[k]
    return mix(out)


def row_sets(h: np.ndarray, word_off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct shingle hashes; a row of fewer words is one shingle, an empty row none."""
    full = shingle_hashes(h, width)
    out = []
    for a, b in zip(word_off[:-1].tolist(), word_off[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            out.append(shingle_hashes(h[a:b], b - a))
        else:
            out.append(full[:0])
    return out


def runs(batches, keys: list[str]):
    """Tables of consecutive rows with equal keys from a sorted stream, one per run."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            cut[1:] |= v[1:] != v[:-1]
        row = [batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys]
        if held and row != last:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        at = [0, *np.flatnonzero(cut).tolist()]
        for a, b in zip(at[:-1], at[1:]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)]).combine_chunks()
            held = []
        held.append(batch.slice(at[-1]))
        last = [batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1].as_py() for k in keys]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
