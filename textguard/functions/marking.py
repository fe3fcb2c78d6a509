"""Words of many texts marked at once: an Arrow helper for :func:`words.text_marks`.

It works on one array of code points for many texts, and settles the words that its tables are
sure of. Every other word is handed back as written and goes through the cascade in Spark.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textguard.functions import charsets as C

#: Characters that are worked on at a time; a longer text makes a slice of its own.
SLICE_CHARS = 1 << 18
#: An open word stands between these two; neither can be in a word.
OPEN, CLOSE = "\n", "\r"

_WS, _PUNCT, _UPPER, _LOWER, _LETTER, _BASE64, _HEX, _LEET, _TWIN, _FOREIGN, _ODD, _HIDDEN, _PERCENT, _DIGIT = (
    1 << i for i in range(14)
)
_LAST = 0x3001


def _flags(code: int) -> int:
    char = chr(code)
    if char in C.WHITESPACE:
        return _WS
    latin = char.isalpha() and (code < 0x80 or 0xC0 <= code <= 0xFF)
    found = _LETTER | (_UPPER if char.isupper() else _LOWER) if latin else 0
    for bit, chars in ((_PUNCT, C.PUNCTUATION), (_LEET, C.LEET), (_TWIN, C.LOOK_ALIKES), (_HEX, "0123456789abcdefABCDEF:,-")):
        found |= bit if char in chars else 0
    if code < 0x80 and (char.isalnum() or char in "+/"):
        found |= _BASE64
    foreign = 0x370 <= code <= 0x4FF and unicodedata.category(char)[0] == "L"
    sign = (0xA1 <= code <= 0xBF or 0x2010 <= code <= 0x205E) and unicodedata.category(char)[0] in "PS"
    if foreign:
        found |= _FOREIGN | _LETTER
    hidden = char in C.INVISIBLES
    if hidden:
        found |= _HIDDEN
    if char == "%":
        found |= _PERCENT
    if char in "0123456789":
        found |= _DIGIT
    if not (latin or foreign or sign or hidden or 0x21 <= code <= 0x7E) or char == "\\":
        found |= _ODD
    return found


_TABLE = np.array([_flags(c) for c in range(_LAST)] + [_ODD], dtype=np.uint16)
_SIXTET = np.zeros(128, dtype=np.uint32)
for _i, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    _SIXTET[ord(_c)] = _i
_NIBBLE = np.full(128, 16, dtype=np.uint8)
for _c in "0123456789abcdefABCDEF":
    _NIBBLE[ord(_c)] = int(_c, 16)
_PRINTABLE = np.array([0x20 <= b <= 0x7E or 9 <= b <= 13 for b in range(256)], dtype=np.uint32)
_ASCII_LOWER = np.array([ord(chr(b).lower()) if b < 0x80 else b for b in range(256)], dtype=np.uint32)
_ENDINGS = {
    n: np.array([int.from_bytes(s[::-1].encode(), "big") for s in C.REVERSED_WORD_STARTS if len(s) == n], dtype=np.uint32)
    for n in {len(s) for s in C.REVERSED_WORD_STARTS}
}
_MARK = {name: ord(mark) for name, mark in C.WORD_MARKS.items()}
_TO_CASCADE = ord("?")


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set from ``start`` to before ``end``; ``start`` is at least 1."""
    sums = np.cumsum(flags, dtype=np.int32)
    return sums[end - 1] - sums[start - 1]


def _cores(text: str, punct: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words without the marks at their edges; a word of marks only becomes empty."""
    start, end = start.copy(), end.copy()
    for edge, look, step in ((start, 0, 1), (end, -1, -1)):
        left = np.flatnonzero((start < end) & punct[edge + look])
        for _ in range(3):
            edge[left] += step
            left = left[(start[left] < end[left]) & punct[edge[left] + look]]
        for i in left:
            word = text[start[i] : end[i]]
            edge[i] += step * (len(word) - len(word.lstrip(C.PUNCTUATION) if step > 0 else word.rstrip(C.PUNCTUATION)))
    return start, end


def _is_base64(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether words of base64 digits, of sizes that four divides, decode to printable bytes."""
    ends = np.cumsum(size)
    if not len(ends):
        return np.zeros(0, dtype=bool)
    digits = _SIXTET[codes[np.arange(ends[-1]) + np.repeat(start - ends + size, size)]].reshape(-1, 4)
    bits = digits[:, 0] << 18 | digits[:, 1] << 12 | digits[:, 2] << 6 | digits[:, 3]
    good = _PRINTABLE[bits >> 16] + _PRINTABLE[bits >> 8 & 255] + _PRINTABLE[bits & 255]
    return np.add.reduceat(good, (ends - size) // 4) / (size // 4 * 3) > C.PRINTABLE_SHARE


def _is_hex(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether words of hex digits and separators decode to printable bytes, eight digits at least."""
    ends = np.cumsum(size)
    if not len(ends):
        return np.zeros(0, dtype=bool)
    digits = _NIBBLE[codes[np.arange(ends[-1]) + np.repeat(start - ends + size, size)]]
    word = np.repeat(np.arange(len(size)), size)[digits < 16]
    digits = digits[digits < 16]
    n = np.bincount(word, minlength=len(size))
    packed = (n >= 8) & (n % 2 == 0)
    pairs = digits[packed[word]].reshape(-1, 2)
    good = np.bincount(word[packed[word]][::2], weights=_PRINTABLE[pairs[:, 0] << 4 | pairs[:, 1]], minlength=len(size))
    return packed & (good / np.maximum(n // 2, 1) > C.PRINTABLE_SHARE)


def _percents(codes: np.ndarray, flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether words have a percent pair, and whether a letter or digit is sure to stand outside of their pairs."""
    digit = _NIBBLE[np.minimum(codes, 127)] < 16
    pair = np.zeros(len(codes), dtype=bool)
    pair[:-2] = (flags[:-2] & _PERCENT != 0) & digit[1:-1] & digit[2:]
    outside = flags & (_LETTER | _DIGIT) != 0
    outside[1:] &= ~pair[:-1]
    outside[2:] &= ~pair[:-2]
    return _between(pair, start, end) > 0, _between(outside, start, end) > 0


def _judged(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marks of the words of a text that begins and ends in whitespace, where they begin, and their cores."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    flags = _TABLE[np.minimum(codes, _LAST)]
    inside = flags & _WS == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first = edges[0::2]
    start, end = _cores(text, flags & _PUNCT != 0, first, edges[1::2])
    marks = np.full(len(first), ord(C.UNCHECKED_MARK), dtype=np.uint8)
    some = np.flatnonzero(start < end)
    if not len(some):
        return marks, first, start, end
    s, e = start[some], end[some]
    size = e - s
    bounds = np.stack([s, e], axis=1).ravel()
    anywhere, everywhere = np.bitwise_or.reduceat(flags, bounds)[::2], np.bitwise_and.reduceat(flags, bounds)[::2]
    letter, lower, upper = (flags & bit != 0 for bit in (_LETTER, _LOWER, _UPPER))
    checked = _between(letter, s, e) >= C.MIN_WORD_LETTERS

    mixed = (anywhere & (_UPPER | _LOWER) == _UPPER | _LOWER) & (size > 3)
    alternating = np.zeros(len(s), dtype=bool)
    if mixed.any():
        cased = lower | upper
        change, untitled = np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=bool)
        change[1:] = letter[1:] & letter[:-1] & (lower[1:] != lower[:-1])
        untitled[1:] = (lower[1:] & ~cased[:-1]) | (upper[1:] & cased[:-1])
        alternating = mixed & (_between(untitled, s, e) > 0) & (_between(change, s, e) * 3 > size)

    tail = {n: _ASCII_LOWER[np.minimum(codes[np.maximum(e - n, 0)], 255)] for n in (1, 2, 3)}
    two = tail[2] << 8 | tail[1]
    backwards = (size > 5) & (np.isin(two, _ENDINGS[2]) | np.isin(tail[3] << 16 | two, _ENDINGS[3]))

    base64 = np.zeros(len(s), dtype=bool)
    maybe = np.flatnonzero(checked & (everywhere & _BASE64 != 0) & (size % 4 == 0))
    base64[maybe] = _is_base64(codes, s[maybe], size[maybe])

    hexed = np.zeros(len(s), dtype=bool)
    maybe = np.flatnonzero(checked & (everywhere & _HEX != 0) & (size >= 8))
    hexed[maybe] = _is_hex(codes, s[maybe], size[maybe])

    # the last that holds is the answer
    told = np.full(len(s), ord(C.CLEAN_MARK), dtype=np.uint8)
    told[alternating] = _MARK["alternating_case"]
    told[backwards] = _MARK["reversed"]
    told[anywhere & _FOREIGN != 0] = _TO_CASCADE
    told[anywhere & _TWIN != 0] = _MARK["char_swaps"]
    told[anywhere & _HIDDEN != 0] = _MARK["invisible_chars"]
    told[anywhere & _LEET != 0] = _MARK["leetspeak"]
    told[hexed] = _MARK["hex"]
    told[base64] = _MARK["base64"]
    if (anywhere & _PERCENT).any():
        paired, lettered = _percents(codes, flags, s, e)
        told[paired] = _TO_CASCADE
        told[paired & lettered] = _MARK["url_encoded"]
    told[~checked] = ord(C.UNCHECKED_MARK)
    told[anywhere & _ODD != 0] = _TO_CASCADE
    marks[some] = told
    return marks, first, start, end


def _told(texts: list[str]) -> list[str]:
    """Per text its words' marks; an open word stands as written between :data:`OPEN` and :data:`CLOSE`."""
    text = "\n" + "\n".join(texts) + "\n"
    marks, first, start, end = _judged(text)
    bounds = np.searchsorted(first, np.cumsum([1] + [len(t) + 1 for t in texts]))
    line = marks.tobytes().decode("ascii")
    opened = np.flatnonzero(marks == _TO_CASCADE)
    spans = np.searchsorted(opened, bounds)
    out = []
    for i in range(len(texts)):
        pieces, at = [], bounds[i]
        for word in opened[spans[i] : spans[i + 1]]:
            pieces += [line[at:word], OPEN, text[start[word] : end[word]], CLOSE]
            at = word + 1
        out.append("".join([*pieces, line[at : bounds[i + 1]]]))
    return out


def _strings(texts: pa.Array) -> list[str | None]:
    try:
        return texts.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()]


@F.arrow_udf(StringType())
def marked(texts: pa.Array) -> pa.Array:
    out: list[str | None] = [None] * len(texts)
    held: list[int] = []
    chars = 0
    rows = _strings(texts)
    for i, text in enumerate(rows):
        if text is not None:
            held.append(i)
            chars += len(text)
        if held and (chars >= SLICE_CHARS or i == len(rows) - 1):
            for at, told in zip(held, _told([rows[j] for j in held]), strict=True):
                out[at] = told
            held, chars = [], 0
    return pa.array(out, pa.string())
