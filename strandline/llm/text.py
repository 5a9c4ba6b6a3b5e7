"""Vectorised work on the UTF-8 bytes of whole text columns.

Everything takes the values buffer and the offsets of an Arrow string column,
so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text makes a larger piece.
CHUNK_BYTES = 1 << 21

#: The bytes that part words: space and 0x09 to 0x0D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])

_rng = np.random.default_rng(0x5EED)
_BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.ones(256, bool)
_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1 << 12)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (three xor-shifts, two products): every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in all texts, and each text's first word (n + 1 places)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = _WORD[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(buf))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that are in order, not empty and do not overlap."""
    global _POWERS
    out = np.empty(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        stop = max(int(np.searchsorted(ends, starts[begin] + CHUNK_BYTES, side="right")), begin + 1)
        s, e = starts[begin:stop], ends[begin:stop]
        size = e - s
        at = np.concatenate(([0], np.cumsum(size)))
        if (longest := int(size.max())) > len(_POWERS):
            _POWERS = _powers(longest)
        inner = np.arange(at[-1]) - np.repeat(at[:-1], size)
        values = _BYTE_KEYS[buf[inner + np.repeat(s, size)]] * _POWERS[inner]
        out[begin:stop] = mix(np.add.reduceat(values, at[:-1]) + size.astype(np.uint64))
        begin = stop
    if len(_POWERS) > 1 << 20:
        _POWERS = _powers(1 << 12)
    return out


def word_hashes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lowered if asked), and each text's first word."""
    buf, offsets = utf8(column)
    starts, ends, firsts = word_bounds(buf, offsets)
    return hash_spans(_LOWER[buf] if lower else buf, starts, ends), firsts
