"""Word shingles as 64-bit numbers, computed on whole Arrow batches with numpy.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]`` of the text with A-Z lower-cased.  A shingle is
five consecutive words; a text with one to four words has its whole sequence as its only shingle; a text
without words (null, empty, white space) has none.

A word's number is a polynomial over its UTF-8 bytes with random 64-bit letters, a shingle's number a
polynomial over its mixed words; both are evaluated modulo 2**64 and mixed.  Two different shingles get the
same number with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5

_rng = np.random.default_rng(20240607)
_LETTER = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_WORD_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE_BASE = 0xC2B2AE3D27D4EB4F | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 8, 1 << max(n - 1, 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.full(size, base, dtype=np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def stretch_numbers(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A number for each stretch ``letters[starts[i]:ends[i]]``; stretches rise and don't overlap.

    Powers count from a stretch's own start, so their table is as long as the longest stretch only.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    n, first = len(letters), int(starts[0])
    power = _power_table(base, int((ends - starts).max()))
    place = np.arange(first, n, dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), np.diff(starts, append=n))
    np.minimum(place, len(power) - 1, out=place)  # places in gaps, which no stretch sums up
    with np.errstate(over="ignore"):
        sums = np.zeros(n - first + 1, dtype=np.uint64)
        np.multiply(letters[first:], power[place], out=sums[1:])
        np.cumsum(sums, out=sums)
        return mix(sums[ends - first] - sums[starts - first])


def _word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word ``data[starts[i]:ends[i]]``."""
    return stretch_numbers(_LETTER[data], starts, ends, _WORD_BASE)


def batch_words(texts: pa.Array, letters: np.ndarray = _LOWER, space: np.ndarray = _SPACE):
    """``(numbers, doc, starts, ends, data)`` of the words of all texts, in order.

    ``letters`` maps each byte to the one that counts, ``space`` tells which mapped bytes part words; starts and
    ends are places in ``data``, the mapped bytes of all texts.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    empty = np.zeros(0, dtype=np.int64)
    none = np.zeros(0, dtype=np.uint64), empty, empty, empty, np.zeros(0, dtype=np.uint8)
    if n == 0:
        return none
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else none[-1]
    offsets = offsets - offsets[0]
    if not len(data):
        return none
    data = letters[data]
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]  # a text's first word starts anew even where no space parts it from the text before
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    stops = offsets[1:][offsets[1:] > 0] - 1
    last[stops] = inside[stops]
    ends = np.flatnonzero(last) + 1
    return _word_numbers(data, starts, ends), np.searchsorted(offsets[1:], starts, side="right"), starts, ends, data


def batch_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(numbers, doc)``: the distinct shingles of each text, doc rising from 0, numbers rising within a doc."""
    words, doc, *_ = batch_words(texts)
    if not len(words):
        return words, doc
    with np.errstate(over="ignore"):
        count = np.bincount(doc)
        place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
        factor = _power_table(_SHINGLE_BASE, 8)
        total = np.zeros(len(words), dtype=np.uint64)
        for k in range(SHINGLE_WORDS):
            reach = max(len(words) - k, 0)
            part = words[k:] * factor[k]
            part[doc[k:] != doc[:reach]] = 0  # words beyond the text's end
            total[:reach] += part
        keep = (place + SHINGLE_WORDS <= count[doc]) | ((count[doc] < SHINGLE_WORDS) & (place == 0))
        total, doc = mix(total[keep] + np.minimum(count, SHINGLE_WORDS)[doc[keep]].astype(np.uint64)), doc[keep]
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    fresh = np.ones(len(total), dtype=bool)
    fresh[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    return total[fresh], doc[fresh]


def slices(texts: pa.Array, most_bytes: int = 2 << 20):
    """``(start, stop)`` row ranges of about ``most_bytes`` of text each; one long text is a range of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start, held = 0, 0
    for i, b in enumerate(size.tolist()):
        if held and held + b > most_bytes:
            yield start, i
            start, held = i, 0
        held += b
    if start < len(size):
        yield start, len(size)
