"""Words and word shingles of whole texts as 64-bit hashes, computed over Arrow buffers.

A word's hash is a polynomial over its bytes modulo 2**64, read off one running sum, so a batch
takes a fixed number of array operations however many words it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _table(separators: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: the value it adds to a hash, A-Z as a-z, and whether it ends a word.

    separators None: every ASCII byte that is no letter or digit is one.
    """
    fold = np.arange(256)
    fold[65:91] += 32
    apart = np.zeros(256, bool)
    if separators is None:
        apart[:128] = [not chr(b).isalnum() for b in range(128)]
    else:
        apart[list(separators)] = True
    return _LETTER[fold], apart


#: White space of the shingle contracts: blank and \x09-\x0D.
BLANKS = _table(b" \t\n\x0b\x0c\r")
ALNUM = _table(None)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array; a null is an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), ends


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of about CHUNK_BYTES; texts are never cut."""
    data, ends = buffers(texts)
    row, n = 0, len(ends) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK_BYTES, "right")) - 1)
        yield row, stop, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def word_spans(data: np.ndarray, ends: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n + 1 offsets of each text's words among them."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~apart[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = ends[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= inside[1:-1][cut]
    last[cut - 1] |= inside[1:-1][cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, ends: np.ndarray, kind=BLANKS, heads: tuple[int, ...] = ()) -> tuple:
    """Hashes, byte starts, byte ends of all words, and each text's offsets among them.

    For each number in heads another array follows: hashes of the words' first so many bytes.
    """
    values, apart = kind
    starts, stops, at = word_spans(data, ends, apart)
    whole, *headed = (span_hashes(data, starts, to, values) for to in (stops, *(np.minimum(stops, starts + n) for n in heads)))
    return whole, starts, stops, at, *headed


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, values: np.ndarray = _LETTER) -> np.ndarray:
    """Hashes of the spans (in order, not overlapping) of some bytes, a block of some CHUNK_BYTES at a time."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + CHUNK_BYTES, "right")))
        low, high = int(starts[i]), int(stops[j - 1])
        up, down = _grown(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=total[1:])
        out[i:j] = mix((total[stops[i:j] - low] - total[starts[i:j] - low]) * down[starts[i:j] - low])
        i = j
    return out


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, the word each begins with, and each text's offsets among them.

    A text with fewer words, but one at least, has its whole sequence as its one shingle.
    """
    n = np.diff(at)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(many)])
    begin = np.arange(to[-1]) - np.repeat(to[:-1] - at[:-1], many)
    length = np.repeat(np.minimum(n, size), many)
    out = length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for j in range(size):
        step = padded[begin + j] * np.uint64((0xE7037ED1A0B428DB * (2 * j + 1) | 1) % 2**64)
        out += step if j == 0 else np.where(length > j, mix(step + np.uint64(j)), np.uint64(0))
    return mix(out), begin, to


def distinct_sorted(values: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and its offsets among them."""
    values = values.copy()
    for a, b in zip(to[:-1].tolist(), to[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    heads = to[:-1][to[:-1] < to[1:]]
    fresh[heads] = True
    return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[to]
