"""Elias-Fano sequences over arrays that may be memory-mapped, and the files that hold them."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

#: Place of the r-th one of a byte, at r << 8 | byte.
_PLACE = np.zeros(8 << 8, np.uint64)
for _b in range(256):
    for _r, _p in enumerate(i for i in range(8) if _b >> i & 1):
        _PLACE[_r << 8 | _b] = _p


def _each(byte: int) -> np.uint64:
    return np.uint64(int.from_bytes(bytes([byte]) * 8, "little"))


_X55, _X33, _X0F, _X01, _X80 = map(_each, (0x55, 0x33, 0x0F, 0x01, 0x80))


def select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th one (from 0) of each 64-bit word, by sums inside the word."""
    u = np.uint64
    sums = x - (x >> u(1) & _X55)
    sums = (sums & _X33) + (sums >> u(2) & _X33)
    sums = (sums + (sums >> u(4)) & _X0F) * _X01  # ones up to and with each byte
    r = r.astype(u)
    place = np.bitwise_count((r * _X01 | _X80) - sums & _X80).astype(u) << u(3)
    rank = r - (sums << u(8) >> place & u(255))
    return (place + _PLACE[rank << u(8) | x >> place & u(255)]).astype(np.int64)


#: Questions answered together; their intermediate arrays stay small.
BLOCK = 1 << 15


def _side_by_side(v: np.ndarray, width: int) -> np.ndarray:
    """Bytes of values of so many bits each (63 at most), without gaps, lowest bits first."""
    size = len(v) * width
    out = np.zeros(-(-size // 64) + 1, np.uint64)
    if size:
        place = np.arange(len(v), dtype=np.int64) * width
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        # each word has the start of a value; no two share a bit
        out[: word[-1] + 1] = np.bitwise_or.reduceat(v << shift, np.flatnonzero(np.r_[True, word[1:] != word[:-1]]))
        over = np.flatnonzero((place & 63) + width > 64)
        out[word[over] + 1] |= v[over] >> (np.uint64(64) - shift[over])
    return out.view(np.uint8)[: -(-size // 8)]


def encode(values: np.ndarray, universe: int, name: str) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays and facts of a non-decreasing sequence of values below universe."""
    v = values.astype(np.uint64)
    n = len(v)
    width = max(0, int(universe // max(1, n)).bit_length() - 1)
    low = np.concatenate((_side_by_side(v & np.uint64((1 << width) - 1), width), np.zeros(8, np.uint8)))
    place = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
    size = n + (int(universe) >> width) + 2
    size += -size % 64
    bits = np.zeros(size, np.uint8)
    bits[place] = 1
    high = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64))).astype(np.uint32)
    return {f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ones}, {f"{name}.width": width, f"{name}.n": n}


class Sequence:
    """Random access and search in an encoded sequence, for arrays of questions at once."""

    def __init__(self, arrays: dict[str, np.ndarray], facts: dict, name: str):
        self.width, self.n = facts[f"{name}.width"], facts[f"{name}.n"]
        low = arrays[f"{name}.low"]
        self.low = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))  # eight bytes from each byte on
        self.high = arrays[f"{name}.high"]
        self.ones = arrays[f"{name}.ones"]  # before each word
        self.zeros = None
        self.last = len(self.high) * 64 - self.n - 1  # the last bucket of high parts, beyond the universe and so empty

    def _select(self, i: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the i-th one, or with flip the i-th zero, in the high bits."""
        if flip and self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        before = self.zeros if flip else self.ones
        word = np.searchsorted(before, i.astype(before.dtype), "right") - 1
        data = self.high[word]
        return word * 64 + select_in_word(~data if flip else data, i - before[word])

    def _after(self, place: np.ndarray, i: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the one (or zero) number i + 1, given that of number i: mostly in the same word, else selected."""
        word, u = place >> 6, np.uint64
        data = self.high[word]
        if flip:
            data = ~data
        data = data & ~((u(2) << (place & 63).astype(u)) - u(1))
        out = (word << 6) + np.bitwise_count((data & (~data + u(1))) - u(1))
        far = np.flatnonzero(data == 0)
        if len(far):
            out[far] = self._select(i[far] + 1, flip)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.width
        return (self.low[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for a in range(0, len(i), BLOCK):
            part = i[a : a + BLOCK]
            out[a : a + BLOCK] = (self._select(part, False) - part << self.width) + self._low(part)
        return out

    def get_both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at i and at i + 1."""
        here, after = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for a in range(0, len(i), BLOCK):
            part = i[a : a + BLOCK]
            place = self._select(part, False)
            here[a : a + BLOCK] = (place - part << self.width) + self._low(part)
            after[a : a + BLOCK] = (self._after(place, part, False) - part - 1 << self.width) + self._low(part + 1)
        return here, after

    def find(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of x among those from first to end, or -1; x is not repeated there, and may be beyond the universe."""
        out = np.zeros(len(x), np.int64)
        for a in range(0, len(x), BLOCK):
            b = a + BLOCK
            out[a:b] = self._find(x[a:b], first[a:b], end[a:b])
        return out

    def _find(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = np.minimum(x >> self.width, self.last)
        before = np.maximum(h - 1, 0)
        place = self._select(before, True)
        lo = np.maximum(np.where(h > 0, place - before, 0), first)
        hi = np.minimum(np.where(h > 0, self._after(place, before, True), place) - h, end)
        want = x & ((1 << self.width) - 1)
        stop = hi.copy()
        while True:  # the first index whose low bits are not below the wanted ones
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            below = self._low(mid) < want[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        out = np.full(len(x), -1)
        ok = np.flatnonzero(lo < stop)
        ok = ok[self._low(lo[ok]) == want[ok]]
        out[ok] = lo[ok]
        return out


def write(path: str, arrays: dict[str, np.ndarray], facts: dict) -> None:
    """A file of arrays, put in place at once, so a task that runs again does no harm."""
    index, at = {}, 0
    for name, a in arrays.items():
        index[name] = [a.dtype.str, at, len(a)]
        at += a.nbytes + -a.nbytes % 8
    head = json.dumps({"arrays": index, "facts": facts}).encode()
    head += b" " * (-len(head) % 8)
    part = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(part, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(part, path)


def read(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """Memory-mapped arrays and facts of a file."""
    data = np.memmap(path, np.uint8, "r")
    n = int(data[:8].view("<u8")[0])
    head = json.loads(data[8 : 8 + n].tobytes())
    out = {}
    for name, (kind, at, count) in head["arrays"].items():
        start = 8 + n + at
        out[name] = data[start : start + np.dtype(kind).itemsize * count].view(kind)
    return out, head["facts"]
