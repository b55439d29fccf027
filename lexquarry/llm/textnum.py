"""Vectorised tokenising and hashing of Arrow string columns, shared by the operators.

A batch of texts is one byte buffer with offsets. Words are runs of bytes of a class, found for all
texts of a slice at once. A word's 64-bit hash weighs each byte by a number drawn for its place, so no
pattern of bytes makes words meet (as powers of a base modulo 2**64 would for Thue-Morse words). A
sequence of k words gets a Rabin-Karp hash of its word hashes, modulo the prime 2**61 - 1; grams that
are compared word by word or counted in sets only get a quicker one. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_WORD_BASE = U64(0xD6E8FEB86659FD93)
PRIME = U64((1 << 61) - 1)
#: Base of the Rabin-Karp hashes, and its inverse modulo PRIME.
_BASE = 0x0D6E8FEB86659FD9
_BACK = pow(_BASE, -1, (1 << 61) - 1)

#: Texts are worked on in slices of about so many bytes (one text may be longer).
SLICE_BYTES = 1 << 20


class WordClass:
    """Which bytes belong to words, and what each byte counts as."""

    def __init__(self, separators: set[int], fold: bool):
        self.word = np.array([b not in separators for b in range(256)])
        value = np.arange(256, dtype=np.uint16) + 1
        if fold:
            value[65:91] += 32
        self.value = value.astype(np.uint64)
        self.fold = fold


_SPACES = {0x20, *range(0x09, 0x0E)}
#: `[^\x20\x09-\x0D]+`, as it stands.
SPACED = WordClass(_SPACES, fold=False)
#: `[^\x20\x09-\x0D]+` of the text with A-Z lower-cased.
SPACED_LOWER = WordClass(_SPACES, fold=True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased: letters, digits, all beyond ASCII.
ALNUM_LOWER = WordClass({b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)}, fold=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive slices."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_drawn: dict[int, np.ndarray] = {}
_powers = {int(_WORD_BASE): np.ones(1, np.uint64)}
_residues: dict[int, np.ndarray] = {}


def drawn(seed: int, n: int) -> np.ndarray:
    """n numbers or more, one for each place, the same in every process."""
    have = _drawn.get(seed)
    if have is None or len(have) < n:
        size = max(n, 1024, 2 * len(have) if have is not None else 0)
        have = _drawn[seed] = mix(mix(np.arange(1, size + 1, dtype=np.uint64) + U64(seed << 40)) + U64(0x9E3779B97F4A7C15))
    return have


def powers(base: U64, n: int) -> np.ndarray:
    have = _powers[int(base)]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have)), base, np.uint64)
        step[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(step)
    return have


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & PRIME) + (x >> U64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo PRIME, of numbers below it."""
    low, high = U64((1 << 31) - 1), U64(31)
    x1, x0, y1, y0 = x >> high, x & low, y >> high, y & low
    middle = x1 * y0 + x0 * y1  # below 2**62
    # x1 * y1 counts 2**62, which is 2; the middle counts 2**31
    total = U64(2) * (x1 * y1) + (middle >> U64(30)) + ((middle & U64((1 << 30) - 1)) << high) + reduced(x0 * y0)
    return reduced(total)


def residues(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo PRIME, or more."""
    have = _residues.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out, done = np.ones(size, np.uint64), 1
        while done < size:
            out[done : 2 * done] = times(out[:done], np.full(done, pow(base, done, int(PRIME)), np.uint64))
            done *= 2
        have = _residues[base] = out
    return have


class Words:
    """Words of a slice of texts: their hashes, byte spans, and for each text the first word (n + 1 bounds)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: WordClass):
        inside = kind.word[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = np.flatnonzero(np.diff(offsets) > 0)
            at = offsets[full]
            first[at] = inside[at]
            at = offsets[full + 1] - 1
            last[at] = inside[at]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        if len(self.start):
            length = self.end - self.start
            begin = np.cumsum(length) - length
            place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(begin, length)
            value = kind.value[data[inside]]
            self.hash = mix(np.add.reduceat(value * drawn(1, int(length.max()))[place], begin) + length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (also across texts: see whole())."""
        return rolling(self.hash, k)

    def whole(self, k: int) -> np.ndarray:
        """Which grams lie in one text."""
        n = max(0, len(self.hash) - k + 1)
        ok = np.ones(n, bool)
        for b in self.bounds[1:-1]:
            ok[max(0, b - k + 1) : b] = False
        return ok


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of h[i : i + k] for every i, by doubling: of short grams only, since it is modulo 2**64."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = powers(_WORD_BASE, k + 1)
    done, size = None, 0
    part, m, left = h, 1, k
    while left:
        if left & 1:
            if done is None:
                done, size = part, m
            else:
                n = len(h) - size - m + 1
                done = done[:n] * base[m] + part[size : size + n]
                size += m
        left >>= 1
        if left:
            n = len(part) - m
            part = part[:n] * base[m] + part[m : m + n]
            m *= 2
    return mix(done + U64(k * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))


def int64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of numpy arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), kind))


def rabin_karp(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of h[i : i + k] for every i: sums of h[j] * base**j from running totals, brought to place 0."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    term = times(reduced(h), residues(_BASE, len(h))[: len(h)])
    window = lambda x: (lambda t: t[k:] - t[: n])(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]))
    low, high = window(term & U64(0xFFFFFFFF)), window(term >> U64(32))  # exact: halves of k terms
    total = reduced(times(reduced(high), np.full(n, 1 << 32, np.uint64)) + reduced(low))
    return times(total, residues(_BACK, n)[:n])


def check_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of h[i : i + k], of 32 bits: by doubling, with each step's sum mixed anew, so it shares no structure with the other."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    size, part = 1, mix(h ^ U64(0x5851F42D4C957F2D))
    while 2 * size <= k:
        part = mix(part[: len(part) - size] * U64(3) + part[size:])
        size *= 2
    return (mix(part[:n] * U64(5) + part[k - size : k - size + n]) >> U64(32)).astype(np.uint32)


def sequence_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's whole sequence of words, each with weights of its own for the places."""
    out = np.zeros((2, len(words.bounds) - 1), np.uint64)
    other = mix(words.hash ^ U64(0x5851F42D4C957F2D))
    for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
        out[0, i] = (words.hash[a:b] * drawn(2, b - a)[: b - a]).sum(dtype=np.uint64) + U64(b - a)
        out[1, i] = (other[a:b] * drawn(3, b - a)[: b - a]).sum(dtype=np.uint64)
    return mix(out[0]), mix(out[1])


def word_counts(kind: WordClass):
    """For mapInArrow: the number of words instead of the texts of the first column, the other columns as they are."""

    def body(batches):
        for batch in batches:
            n = [np.diff(Words(data, offsets, kind).bounds) for _, _, data, offsets in slices(batch.column(0))]
            n = pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([n, *(batch.column(i) for i in range(1, batch.num_columns))], ["n", *batch.schema.names[1:]])

    return body
