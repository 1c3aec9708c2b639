"""Pre-tokens of byte-level BPE, found on whole batches with numpy.

The pattern splits a text into the English contractions, runs of letters, of digits and of other signs, each
with one space before it, and runs of white space, of which the last character is left to what follows.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from tallyforge.llm.shingles import mix, stretch_numbers

_BASE = 0xD6E8FEB86659FD93 | 1
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Fixed: the characters that Unicode counts as white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Fixed: what may follow an apostrophe in a contraction.
SHORT, LONG = "stmd", ("re", "ve", "ll")


@functools.cache
def _kinds() -> np.ndarray:
    kinds = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    kinds[WHITE] = SPACE
    return kinds


@functools.cache
def _letters() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


def batch_pretokens(texts: list[str]):
    """``(numbers, doc, starts, ends, codes)``; starts and ends are places in ``codes``, all texts' code points."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    stops = np.cumsum(sizes)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none, codes
    kind = _kinds()[codes]
    head = np.zeros(n + 1, dtype=bool)  # where a text begins
    head[0] = True
    head[stops] = True
    run = head.copy()  # where a run of one kind begins
    run[1:-1] |= kind[1:] != kind[:-1]
    begin = run[:-1].copy()
    tail = run[1:]  # a run's last place
    # White space before something in its text: its last character goes with that if it is a blank, else alone.
    white_tail = tail & (kind == SPACE) & ~head[1:]
    at = np.flatnonzero(white_tail)
    begin[at] = True
    blank = at[codes[at] == 0x20]
    begin[blank + 1] = False
    # Contractions: a lone apostrophe that no blank was drawn to, before letters of its text.
    lone = np.flatnonzero((codes == 0x27) & begin & tail)
    lone = lone[lone + 1 < n]
    lone = lone[~head[lone + 1]]
    if len(lone):
        letter = kind[lone + 1] == LETTER
        lone = lone[letter]
        one = np.isin(codes[lone + 1], [ord(c) for c in SHORT])
        second = np.zeros(len(lone), dtype=np.uint32)
        inner = lone + 2 < n
        inner[inner] &= ~head[lone[inner] + 2]
        second[inner] = codes[lone[inner] + 2]
        two = np.zeros(len(lone), dtype=bool)
        for a, b in LONG:
            two |= (codes[lone + 1] == ord(a)) & (second == ord(b))
        for where, size in ((lone[one], 1), (lone[two & ~one], 2)):
            begin[where + 1] = False
            begin = np.append(begin, True)
            begin[where + 1 + size] = True
            begin = begin[:n]
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    numbers = stretch_numbers(_letters()[codes], starts, ends, _BASE)
    return numbers, np.searchsorted(stops, starts, side="right"), starts, ends, codes


def text_of(codes: np.ndarray, start: int, end: int) -> str:
    return codes[start:end].tobytes().decode("utf-32-le", "surrogatepass")
