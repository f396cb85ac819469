"""Pre-splitting of texts into words, for a whole batch at once, by character classes instead of a regular expression.

It yields the pieces of the usual byte-level pattern: contractions, runs of letters, of digits and of other signs, each
with one leading space, and white space, of which the last blank goes to the word that follows.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

# The characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe in a contraction.
ONE_LETTER, TWO_LETTERS = "sdmt", ("ll", "ve", "re")


@functools.cache
def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_starts(codes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Places at which a word begins, for the joined texts of a batch; heads: where each (non-empty) text begins."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[codes]
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= head[:n]
    # the last blank of white space goes to what follows in the same text
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~head[1:n])
    start[last] = True
    start[last[codes[last] == 0x20] + 1] = False
    # contractions begin where a word begins with an apostrophe
    quote = np.flatnonzero((codes == 0x27) & start)
    if len(quote):
        padded = np.r_[codes, [0, 0]]
        ends = np.r_[head, [True]]
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~ends[quote + 1]
        short = inside & np.isin(one, [ord(c) for c in ONE_LETTER])
        long = inside & ~ends[np.minimum(quote + 2, n)] & np.any([(one == ord(a)) & (two == ord(b)) for a, b in TWO_LETTERS], axis=0)
        start[quote[short | long] + 1] = False
        after = np.r_[quote[short] + 2, quote[long] + 3]
        start[after[after < n]] = True
    return np.flatnonzero(start)
