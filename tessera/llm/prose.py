"""Segments of a text, whatever its layout: the pieces between stops, as numbers that a learned model can judge.

Nothing here knows a language. Layout (line marks, blank lines, stops) is told by general punctuation; what the words of a
segment say is left to weights learned from the corpus (quality.py). Words are named by hash buckets, so that a model has a
fixed size whatever the vocabulary.
"""

from __future__ import annotations

import re
import zlib

#: Hash buckets of words (from FIRST_WORD on), and four that name no word: numbers, runs of letters and digits, pieces with
#: neither, and words that one of the NEAR words before is too.
BUCKETS = 1 << 18
NUMBER, MIXED, MARK, REPEATED, FIRST_WORD = range(5)
NEAR = 4
#: A segment that surely is a sentence has so many words, so large a share of letters, and a stop.
SURE_WORDS, SURE_LETTERS = 6, 0.6
#: Bits of a segment's kind: its first occurrence in the text, surely a sentence, surely without a stop.
FIRST, SURE, OPEN = 1, 2, 4

LINES = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
# marks that a layout puts before a line: quotes, comments, headings, bullets, numbers, speakers
MARKS = re.compile(r"(?:(?:>+|//+|#+|=+|[-*+•–—·▪◦]|\(?\[?\d{1,3}[\])]+\.?|\d{1,3}\.(?=\s)|[^\W\d_]{1,2}:(?=\s)|;;|--|%+|\|)[ \t]*)+")
ITEM = re.compile(r"(?:[-*+•]|\(?\[?\d{1,3}[\])]|\d{1,3}\.|[^\W\d_]:)\s")
STOPS = re.compile(r"([.!?…][\"'»”’)\]]*\s+|[。！？])")
RUN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
FINAL = re.compile(r"[.!?…。！？।؟][\"'»”’)\]]*$")
WIDE = re.compile("[฀-๿぀-ヿ㐀-鿿가-힯]")

STATISTICS = ["chars", "words", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_ratio", "repeated_line_ratio"]


class Buckets(dict):
    """Run of letters and digits to its bucket, kept for runs seen before."""

    def __missing__(self, run: str) -> int:
        if len(self) > 400_000:
            self.clear()
        if any(map(str.isdigit, run)):
            found = NUMBER if not any(map(str.isalpha, run)) else MIXED
        else:
            found = FIRST_WORD + zlib.crc32(run.encode("utf-8", "surrogatepass")) % (BUCKETS - FIRST_WORD)
        self[run] = found
        return found


_BUCKETS = Buckets()


def paragraphs(text: str) -> tuple[list[str], list[str]]:
    """(paragraphs, lines): lines without their marks, and joined where a sentence may run on into the next line."""
    lines = LINES.split(text)
    found: list[str] = []
    current: list[str] = []
    for line in lines:
        line = line.strip()
        mark = MARKS.match(line)
        if current and (not line or ITEM.match(line)):
            found.append(" ".join(current))
            current = []
        if mark:
            line = line[mark.end() :].strip()
        if line:
            current.append(line)
    if current:
        found.append(" ".join(current))
    return found, lines


def runs_of(segment: str) -> list[str]:
    """Runs of letters and digits in lower case; of scripts without blanks, pairs of neighbouring characters."""
    runs = RUN.findall(segment.lower().replace("’", "'"))
    if segment.isascii() or not WIDE.search(segment):
        return runs
    out = []
    for run in runs:
        out += [run[k : k + 2] for k in range(max(1, len(run) - 1))] if WIDE.search(run) else [run]
    return out


def describe(text: str) -> tuple[tuple[float, ...], list[int], list[int], list[int], list[int]]:
    """(STATISTICS, word buckets of all segments, words, characters and kind of each segment) of a text that is not blank."""
    stripped = text.strip()
    total = len(stripped)
    parts, lines = paragraphs(text)
    seen: set[str] = set()
    buckets: list[int] = []
    counts: list[int] = []
    chars: list[int] = []
    kinds: list[int] = []
    word_chars = n_words = 0
    for part in parts:
        cuts = STOPS.split(part)
        cuts.append("")
        for k in range(0, len(cuts) - 1, 2):
            pieces = (cuts[k] + cuts[k + 1]).split()
            if not pieces:
                continue
            segment = " ".join(pieces)
            runs = runs_of(segment)
            at = list(map(_BUCKETS.__getitem__, runs))
            words = [run for run, bucket in zip(runs, at) if bucket >= FIRST_WORD]
            n, letters = len(words), sum(map(len, words))
            n_words += n
            word_chars += letters
            if len(set(at)) < len(at):
                at = [REPEATED if b >= FIRST_WORD and b in at[max(0, k - NEAR) : k] else b for k, b in enumerate(at)]
            at += [MARK] * (len(pieces) - len(runs))
            buckets += at
            key = segment.rstrip(".!?…").lower()
            kind = 0
            if key not in seen:
                seen.add(key)
                kind = FIRST
            if not FINAL.search(segment):
                kind |= OPEN
            elif n >= SURE_WORDS and letters >= SURE_LETTERS * (len(segment) - len(pieces) + 1):
                kind |= SURE
            counts.append(len(at))
            chars.append(len(segment) + 1)
            kinds.append(kind)
    filled = [line for line in map(str.strip, lines) if line]
    digits = sum(map(stripped.count, "0123456789"))
    solid = max(1, len("".join(stripped.split())))
    values = (
        float(total),
        float(n_words),
        word_chars / n_words if n_words else 0.0,
        max(0, solid - word_chars - digits) / solid,
        digits / solid,
        sum(1 for line in filled if FINAL.search(line)) / max(1, len(filled)),
        1 - len(set(filled)) / max(1, len(filled)),
    )
    return values, buckets, counts, chars, kinds
