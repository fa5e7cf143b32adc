"""Words of whole byte views as numbers, with flat arrays of what is wanted for each word.

A word here is any run of bytes that is encoded by itself. Nearly all words of a view are found with a
few vector steps: one of up to 24 bytes is its length and three 64-bit integers, which lead to a cell of a
direct-mapped table, and the word in that cell is compared in full. Words that no cell holds go
through a dictionary of bytes, and only words that nobody has met go to the caller's ``resolve``.
No step takes a hash for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import LOWER, SPACE, views, words_in

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_CELL_BITS = 20
_KEY_BYTES = 24


class Growing:
    """An array with room at its end."""

    def __init__(self, kind, first=()):
        self.data, self.n = np.zeros(1 << 12, kind), 0
        self.add(np.array(first, kind))

    def add(self, part: np.ndarray) -> None:
        if self.n + len(part) > len(self.data):
            more = np.zeros(max(2 * len(self.data), self.n + len(part)), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : self.n + len(part)] = part
        self.n += len(part)


def gather(flat: np.ndarray, edge: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[edge[i]:edge[i + 1]] for each number i, end to end, and where each starts and the last ends."""
    a = edge[numbers]
    size = edge[numbers + 1] - a
    out = np.zeros(len(numbers) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return flat[np.repeat(a - out[:-1], size) + np.arange(out[-1])], out


class WordTable:
    """Numbers of words from 1 on; product k of word w is ``gather(k, numbers)``'s part for it.

    ``resolve`` takes distinct words and gives, for each product, the words' values end to end and how many
    each has. The first ``remember`` words, up to ``remember_bytes`` of letters and products, stay; later
    ones last for one call.
    """

    def __init__(self, resolve, kinds: tuple, remember: int = 250_000, remember_bytes: int = 48 << 20):
        self._resolve = resolve
        self._number: dict[bytes, int] = {}
        self._words: list[bytes] = [b""]
        self._flat = [Growing(k) for k in kinds]
        self._edge = [Growing(np.int64, (0, 0)) for _ in kinds]
        self._limit, self._room = remember + 1, remember_bytes
        self._cells = np.zeros((2, 1 << _CELL_BITS), np.int32)
        self._keys = np.zeros((4, remember + 1), np.uint64)
        self._keys[3, 0] = np.uint64(1 << 63)  # number 0 is no word

    def __len__(self) -> int:
        return len(self._words)

    def words(self) -> list[bytes]:
        """All words held, by number; number 0 is none."""
        return self._words

    def _forget(self) -> None:
        limit = self._limit
        if len(self._words) <= limit:
            return
        for w in self._words[limit:]:
            del self._number[w]
        del self._words[limit:]
        for flat, edge in zip(self._flat, self._edge, strict=True):
            edge.n = limit + 1
            flat.n = int(edge.data[limit])

    def _learn(self, words: list[bytes]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self._number]
        if not new:
            return
        at = len(self._words)
        self._number.update(zip(new, range(at, at + len(new)), strict=True))
        self._words += new
        size = sum(map(len, new)) + 100 * len(new)
        for flat, edge, (values, count) in zip(self._flat, self._edge, self._resolve([w.decode("utf-8", "replace") for w in new]), strict=True):
            edge.add(flat.n + np.cumsum(count))
            flat.add(values)
            size += values.nbytes
        self._room -= size
        if self._room < 0:
            self._limit = min(self._limit, at)

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word data[start:end]; they hold until the next call."""
        self._forget()
        if not len(start):
            return np.zeros(0, np.int64)
        n = end - start
        padded = np.zeros(len(data) + _KEY_BYTES, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray(len(data) + _KEY_BYTES - 7, "<u8", padded, strides=(1,))
        key = [eight[start + 8 * k] & _MASK[np.clip(n - 8 * k, 0, 8)] for k in range(3)] + [n.astype(np.uint64)]
        with np.errstate(over="ignore"):
            h = key[0] * _FACTORS[0] + key[1] * _FACTORS[1] + key[2] * _FACTORS[2] + key[3]
            h = (h ^ (h >> np.uint64(29))) * _FACTORS[3]
        spot = (h >> np.uint64(64 - _CELL_BITS)).astype(np.int64), ((h >> np.uint64(20)) & np.uint64((1 << _CELL_BITS) - 1)).astype(np.int64)
        out = self._cells[0][spot[0]].astype(np.int64)
        miss = np.flatnonzero(~self._same(out, key))
        if len(miss):
            other = self._cells[1][spot[1][miss]].astype(np.int64)
            fine = self._same(other, [k[miss] for k in key])
            out[miss[fine]] = other[fine]
            miss = miss[~fine]
        if len(miss):
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(start[miss].tolist(), end[miss].tolist(), strict=True)]
            self._learn(words)
            out[miss] = np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))
            self._install(out, miss[(n[miss] <= _KEY_BYTES) & (out[miss] < self._limit)], key, spot)
        return out

    def _same(self, number: np.ndarray, key: list[np.ndarray]) -> np.ndarray:
        fine = self._keys[3][number] == key[3]
        for k in range(3):
            fine &= self._keys[k][number] == key[k]
        return fine

    def _install(self, out: np.ndarray, at: np.ndarray, key, spot) -> None:
        """Words take a free cell of either table; where both are taken the dictionary stays their way."""
        for cells, where in zip(self._cells, spot, strict=True):
            free = at[cells[where[at]] == 0]
            cells[where[free]] = out[free]
            at = at[cells[where[at]] != out[at]]
            done = free[cells[where[free]] == out[free]]
            for k in range(4):
                self._keys[k][out[done]] = key[k][done]

    def gather(self, product: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the words' arrays end to end, where each starts and the last ends)."""
        return gather(self._flat[product].data, self._edge[product].data, numbers)


#: Kinds of bytes: white space, letters, digits, others; of two-byte Latin-1 characters by their second byte.
_WHITE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[SPACE] = _WHITE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND_C2 = np.full(256, _OTHER, np.uint8)
_KIND_C2[[0x85, 0xA0]] = _WHITE
_KIND_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_KIND_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
_KIND_C3 = np.full(256, _LETTER, np.uint8)
_KIND_C3[[0x97, 0xB7]] = _OTHER
_APOSTROPHE = 0x27


def units_in(offs: np.ndarray, data: np.ndarray):
    """(bytes with small letters, starts, ends, rows) of the units that are encoded by themselves.

    In words of Latin-1 letters these are the vocabulary's pre-tokens: a contraction ('s 't 'm 'd 're 've
    'll), a run of letters, a digit, a run of others. A word with other letters, or with ``<|`` as special
    tokens have it, is one unit as it is written.
    """
    low, kind = LOWER[data], _KIND[data]
    odd = data >= 0xC4
    mark = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    odd[mark] = True
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    lead = lead[lead + 1 < len(data)]
    if len(lead):
        follow = data[lead + 1]
        c3 = data[lead] == 0xC3
        kind[lead] = kind[lead + 1] = np.where(c3, _KIND_C3[follow], _KIND_C2[follow])
        capital = lead[c3 & (follow >= 0x80) & (follow <= 0x9E) & (follow != 0x97)] + 1
        low[capital] += 0x20
    if odd.any():
        start, end, _ = words_in(data, offs, ~SPACE)
        count = np.zeros(len(data) + 1, np.int64)
        np.cumsum(odd, out=count[1:])
        whole = count[end] > count[start]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[start[whole]] += 1
        edge[end[whole]] -= 1
        raw = np.cumsum(edge[:-1]).astype(bool)
        low[raw] = data[raw]
        kind[raw] = _LETTER
    begins = np.ones(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins |= (kind == _DIGIT) & ((data & 0xC0) != 0x80)
    inner = offs[1:-1]
    begins[inner[inner < len(data)]] = True
    mark = np.flatnonzero((low[:-2] == _APOSTROPHE) & begins[:-2] & begins[1:-1] & (kind[1:-1] == _LETTER)) if len(data) > 2 else np.zeros(0, np.int64)
    if len(data) > 1 and low[-2] == _APOSTROPHE and begins[-2] and kind[-1] == _LETTER:
        mark = np.append(mark, len(data) - 2)
    # An apostrophe at the end of its row stands before another row's letters.
    mark = mark[~np.isin(mark + 1, offs)]
    if len(mark):
        first = low[mark + 1]
        more = np.minimum(mark + 2, len(data) - 1)
        pair = (mark + 2 < len(data)) & ~begins[more]
        second = low[more]
        two = pair & (((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l")))
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        begins[(mark + 1)[one | two]] = False
        after = np.concatenate([mark[one] + 2, mark[two] + 3])
        after = after[after < len(data)]
        begins[after] |= kind[after] != _WHITE
    at = np.flatnonzero(begins)
    end = np.append(at[1:], len(data)) if len(at) else at
    keep = kind[at] != _WHITE
    start, end = at[keep], end[keep]
    return low, start, end, np.searchsorted(offs, start, side="right") - 1


def unit_views(text: pa.Array):
    """(first row, offsets, bytes, starts, ends, first unit of each row and the end) of views of a text column."""
    for first, offs, data in views(text):
        low, start, end, row = units_in(offs, data)
        edge = np.zeros(len(offs), np.int64)
        np.cumsum(np.bincount(row, minlength=len(offs) - 1), out=edge[1:])
        yield first, offs, low, start, end, edge
