"""Elias-Fano sequences and a two-level n-gram trie over them, in numpy and memory-mapped."""

from __future__ import annotations

import tempfile

import numpy as np

_BITS = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)
for _x in range(256):
    _places = [b for b in range(8) if _x >> b & 1]
    _SELECT[_x, : len(_places)] = _places

#: Values handled at once where bits or search states are spread out.
_LOT = 1 << 16


class EliasFano:
    """A monotone sequence below ``universe``: packed low bits, unary high bits with a rank directory."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * width + 7) // 8 + 8, np.uint8)
        for begin in range(0, n if width else 0, _LOT):  # a lot's bits fill whole bytes
            bits = ((values[begin : begin + _LOT, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(bits.reshape(-1), bitorder="little")
            low[begin * width // 8 :][: len(packed)] = packed
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((int(at[-1]) if n else 0) // 64 + 1) * 64, np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little")
        ones = np.concatenate(([0], np.cumsum(_BITS[high].reshape(-1, 8).sum(1, dtype=np.int64))))
        return n, width, low, high, ones

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        left = i - self.ones[word]
        byte = word * 8
        for _ in range(7):
            here = _BITS[self.high[byte]]
            go = left >= here
            if not go.any():
                break
            left = left - np.where(go, here, 0)
            byte = byte + go
        high = (byte * 8 + _SELECT[self.high[byte], left] - i).astype(np.uint64) << np.uint64(self.width)
        if not self.width:
            return high
        windows = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        bit = i * self.width
        return high | ((windows[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1))


class BigramTrie:
    """Contexts, monotone pointers to their successors, successors, and a code for each successor.

    Successors rise within a context; the last stored value of the context before
    is added, so that the whole level is one monotone sequence.  A trie is stored
    as one run of bytes (``stored``); to be read it lies in an unlinked temporary
    file of the task that is mapped, and no level of it is decoded as a whole.
    """

    LEVELS = 4

    @staticmethod
    def stored(contexts: np.ndarray, successors: np.ndarray, codes: np.ndarray) -> bytes:
        """The bytes of the trie of one entry per n-gram, sorted by context and then successor."""
        first = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1]))) if len(contexts) else np.zeros(0, np.int64)
        pointers = np.concatenate((first, [len(contexts)])).astype(np.int64)
        size = np.diff(pointers)
        last = successors[pointers[1:] - 1].astype(np.int64) if len(first) else np.zeros(0, np.int64)
        shift = np.concatenate(([0], np.cumsum(last + 1)[:-1])) if len(first) else np.zeros(0, np.int64)
        stored = successors.astype(np.int64) + np.repeat(shift, size)
        top = lambda a: int(a[-1]) + 1 if len(a) else 1
        levels = [EliasFano.parts(a, top(a)) for a in (contexts[first], pointers, stored, shift)]
        arrays = [np.ascontiguousarray(x) for p in levels for x in p[2:]] + [codes.astype(np.uint8)]
        head = np.array([x for p in levels for x in p[:2]] + [a.nbytes for a in arrays], "<i8").tobytes()
        return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    def __init__(self, blob: bytes):
        numbers = 2 * self.LEVELS + 3 * self.LEVELS + 1
        head = np.frombuffer(blob, "<i8", numbers)
        self._file = tempfile.TemporaryFile()
        self._file.write(blob)
        self._file.flush()
        whole = np.memmap(self._file, np.uint8, "r")
        at, mapped = numbers * 8, []
        for k, size in enumerate(head[2 * self.LEVELS :].tolist()):
            kind = np.int64 if k < 3 * self.LEVELS and k % 3 == 2 else np.uint8
            mapped.append(whole[at : at + size].view(kind))
            at += size + -size % 8
        sequence = [EliasFano(int(head[2 * k]), int(head[2 * k + 1]), *mapped[3 * k : 3 * k + 3]) for k in range(self.LEVELS)]
        self.contexts, self.pointers, self.successors, self.shifts = sequence
        self.codes = mapped[-1]

    def close(self) -> None:
        self._file.close()

    @staticmethod
    def _first_not_below(level: EliasFano, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Successor search: the first place in low .. high whose value is ``wanted`` or more; ``high`` if there is none."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = level.access(middle) < wanted[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low

    def lookup(self, contexts: np.ndarray, successors: np.ndarray, absent: int) -> np.ndarray:
        """The code of each (context, successor); ``absent`` where the n-gram is not stored."""
        lots = [self._lookup(contexts[k : k + _LOT], successors[k : k + _LOT], absent) for k in range(0, len(contexts), _LOT)]
        return np.concatenate(lots) if lots else np.zeros(0, np.uint8)

    def _lookup(self, contexts: np.ndarray, successors: np.ndarray, absent: int) -> np.ndarray:
        out = np.full(len(contexts), absent, np.uint8)
        n = self.contexts.n
        if not n:
            return out
        asked, which = np.unique(contexts.astype(np.uint64), return_inverse=True)
        k = self._first_not_below(self.contexts, asked, np.zeros(len(asked), np.int64), np.full(len(asked), n, np.int64))
        held = k < n
        held[held] = self.contexts.access(k[held]) == asked[held]
        known = np.flatnonzero(held[which])
        k = k[which[known]]
        low, end = self.pointers.access(k).astype(np.int64), self.pointers.access(k + 1).astype(np.int64)
        wanted = self.shifts.access(k) + successors[known].astype(np.uint64)
        low = self._first_not_below(self.successors, wanted, low, end)  # within the context's own range
        inside = np.flatnonzero(low < end)
        hit = inside[self.successors.access(low[inside]) == wanted[inside]]
        out[known[hit]] = self.codes[low[hit]]
        return out
