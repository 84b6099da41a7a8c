"""Vectorised text primitives over Arrow string columns.

A block is the concatenated UTF-8 bytes of some documents (``data``) and the
documents' offsets into it (``off``, one more than there are documents).  All
functions work on whole texts; nulls count as empty texts.  Memory is linear in
the block's bytes, so callers cut their input with :func:`iter_blocks`.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def _return_memory() -> None:
    """Have large arrays go back to the system when they are freed: workers share a small memory.

    The C library otherwise raises the size from which it does so to 32 MB, and
    Arrow's default pool keeps what it once had."""
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


def reuse_memory() -> None:
    """Have arrays of up to 32 MB come from memory that was used before, of which 64 MB stay.

    For workers whose arrays are small and many: new pages would cost them a third of their time."""
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


_return_memory()
_MASK = (1 << 64) - 1


def _splitmix(i: int) -> int:
    z = (i * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


#: One random 64-bit value for each byte, by rule.
BYTE_VALUES = np.array([_splitmix(i) for i in range(256)], dtype=U)
_BASE = _splitmix(1001) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _lut(*chars: int) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


#: Separators of ``[^\x20\x09-\x0D]+`` words.
SPACE = _lut(0x20, *range(0x09, 0x0E))
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` words (after lower-casing).
NON_ALNUM = _lut(*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of the result depend on all bits of h."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo 2**64, with a leading zero."""
    out = np.zeros(len(values) + 1, dtype=U)
    np.multiply(values, _power_table(_BASE, len(values)), out=out[1:])
    return np.cumsum(out, dtype=U, out=out)


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) that depend on their contents alone."""
    inv = _power_table(_BASE_INV, len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def window_hash(values: np.ndarray, k: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Hash of values[i : i + k] for each i with a full window; sums: the values' prefix sums, if there are."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    sums = prefix_sums(values) if sums is None else sums
    inv = _power_table(_BASE_INV, len(sums))
    return mix((sums[k:] - sums[:n]) * inv[:n])


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(data, off) of an Arrow string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = pc.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def iter_blocks(batches: Iterator[pa.RecordBatch], text: str, budget: int = 8 << 20, *, sized: bool = False) -> Iterator[pa.Table]:
    """The rows in order, in tables of about ``budget`` bytes of text (one row at least); sized: the column tells the bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        lens = np.asarray(pc.fill_null(col if sized else pc.binary_length(col), 0)).astype(np.int64)
        at = 0
        sums = np.cumsum(lens)
        while at < batch.num_rows:
            done = sums[at - 1] if at else 0
            cut = int(np.searchsorted(sums, done + budget - size, side="left")) + 1
            cut = min(cut, batch.num_rows)
            held.append(batch.slice(at, cut - at))
            size += int(sums[cut - 1] - done)
            at = cut
            if size >= budget:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def word_spans(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document index) of the maximal runs of bytes that are no separators."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = off[:-1][off[:-1] < len(data)]
    first[heads] = inside[heads]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags over each document's range."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places lie in some window [start, start + k)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + k, n), -1)
    return np.cumsum(steps[:-1]) > 0


def shifted(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending uint64 values as differences of the least byte width that holds them."""
    if len(sorted_values) == 0:
        return b""
    deltas = np.diff(sorted_values)
    width = max(1, (int(deltas.max()).bit_length() + 7) // 8) if len(deltas) else 1
    body = deltas.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return bytes([width]) + int(sorted_values[0]).to_bytes(8, "little") + body


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U)
    width, first = raw[0], int.from_bytes(raw[1:9], "little")
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(body) + 1, 8), np.uint8)
    wide[1:, :width] = body
    out = wide.reshape(-1).view("<u8").astype(U)
    out[0] = first
    return np.cumsum(out, dtype=U)
