"""Words of a batch of texts as arrays: boundaries and 64-bit hashes, without a loop over words.

A word's hash is a polynomial over its bytes modulo 2^64, taken from prefix sums over the whole
block, then mixed. Texts are handled in blocks of a few megabytes, so memory is bounded by the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
#: Blocks where a worker holds much else beside them, since words take many times their text meanwhile.
SMALL_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        row = np.full(max(n, SMALL_BYTES + 1), base, np.uint64)
        row[0] = 1
        known = np.multiply.accumulate(row)
        if n <= 2 * BLOCK_BYTES + 1:
            _powers[int(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, the value of each, and its folded form."""

    inside: np.ndarray
    value: np.ndarray
    fold: bytes


def _alphabet(inside: np.ndarray) -> Alphabet:
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[fold]
    value[~inside] = 0
    fold[~inside] = 32
    return Alphabet(inside, value, fold.tobytes())


_codes = np.arange(256)
#: Letters, digits and everything beyond ASCII.
LETTERS = _alphabet(
    ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90))
    | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
)
#: Everything but blank, tab, line feed, vertical tab, form feed and carriage return.
VISIBLE = _alphabet(~((_codes == 32) | ((_codes >= 9) & (_codes <= 13))))


@dataclass(frozen=True)
class Words:
    """Words of the texts ``first`` .. ``first + n - 1`` of a batch, in order."""

    first: int
    n: int
    data: np.ndarray  # bytes of the block
    offsets: np.ndarray  # n + 1 positions in data
    starts: np.ndarray  # position of each word in data
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # n + 1 positions in starts: the words of each text

    def owner(self) -> np.ndarray:
        """Index of the text of each word, counted from ``first``."""
        return np.repeat(np.arange(self.n), np.diff(self.bounds))


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    data, offsets = layout(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(column: pa.Array, alphabet: Alphabet, size: int = BLOCK_BYTES) -> Iterator[Words]:
    for first, data, offsets in blocks(column, size):
        yield split(first, data, offsets, alphabet)


def split(first: int, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> Words:
    return runs(first, data, offsets, alphabet.inside.take(data), alphabet.value)


def borders(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal runs of bytes marked as ``inside`` start and end."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def runs(first: int, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, value: np.ndarray) -> Words:
    """Maximal runs of bytes marked as ``inside``, hashed by the ``value`` of each byte."""
    starts, ends = borders(data, offsets, inside)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.take(value, data, out=sums[1:], mode="clip")
    sums[1:] *= powers(BASE, len(data))
    np.cumsum(sums[1:], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts]
    hashes = mix(hashes ^ (ends - starts).astype(np.uint64))
    return Words(first, len(offsets) - 1, data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive hashes."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, len(hashes)), out=sums[1:])
    return mix((sums[length:] - sums[:n]) * powers(INVERSE, n) ^ np.uint64(length))


def folded(words_of: Words, alphabet: Alphabet, start: int, stop: int) -> bytes:
    """Words ``start`` .. ``stop - 1``, folded and joined by single blanks: their exact identity."""
    part = words_of.data[words_of.starts[start] : words_of.ends[stop - 1]].tobytes()
    return b" ".join(part.translate(alphabet.fold).split())
