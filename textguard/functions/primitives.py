"""Text primitives: trimming, splitting, counting and guarded decoding.

All take and return Columns. Decoders return NULL where the input is not well
formed, so nothing here can fail a task under ANSI mode.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import charsets as C

def listed(ranges: str) -> str:
    """A character class that lists the letters and digits of its ranges: Java looks a listed one up at once."""
    return "[" + re.sub("(.)-(.)", lambda r: "".join(map(chr, range(ord(r[1]), ord(r[2]) + 1))), ranges) + "]"


HEX_DIGIT = listed("0-9a-fA-F")
HEX_PAIR = f"%{HEX_DIGIT}{{2}}"
UNICODE_ESCAPE = f"\\\\u{HEX_DIGIT}{{4}}|\\\\U{HEX_DIGIT}{{8}}"
# One well-formed backslash escape. What is left after removing these is plain
# text; a backslash still in it means the text does not decode.
ANY_ESCAPE = (
    f"(?s)\\\\(?:u{HEX_DIGIT}{{4}}|U00(?:0{HEX_DIGIT}|10){HEX_DIGIT}{{4}}"
    f"|x{HEX_DIGIT}{{2}}|[0-7]{{1,3}}|[^uUxN0-7])"
)
_BASE64_TEXT = f"^{listed('A-Za-z0-9+/')}*={{0,2}}\\z"
_NOT_PRINTABLE = "[" + "".join(f"\\x{b:02x}" for b in range(256) if not (0x20 <= b <= 0x7E or 9 <= b <= 13)) + "]+"
_LOWER = "[\\p{L}&&\\p{IsLowercase}]"
_NOT_LOWER = "[\\p{L}&&\\P{IsLowercase}]"
_CASED = "[\\p{IsLowercase}\\p{IsUppercase}\\p{Lt}]"
_CASE_CHANGE = (
    f"(?<={_LOWER})(?={_NOT_LOWER})|(?<={_NOT_LOWER})(?={_LOWER})"
)
# A cased letter where title case would have put the other case.
_NOT_TITLE = f"(?<!{_CASED})\\p{{Ll}}|(?<={_CASED})[\\p{{Lu}}\\p{{Lt}}]"
# Word gap: whitespace with any punctuation hanging on to it, each run of marks
# entered once only, so a long run of marks costs linear time.
_WORD_GAP = f"(?:(?<!\\p{{Punct}})\\p{{Punct}}++)?{C.WS}+\\p{{Punct}}*"


# The same gap for texts whose whitespace is all Latin-1, begun by one look-up a character.
_MARK = "[" + re.escape(C.PUNCTUATION) + "]"
_LATIN_WS = C.WS[: C.WS.index("\\u1680")] + "]"
_LATIN_GAP = (
    f"[{_MARK[1:-1]}{_LATIN_WS[1:-1]}]"
    f"(?:(?<={_LATIN_WS}){_LATIN_WS}*+|(?<={_MARK})(?<!{_MARK}{_MARK}){_MARK}*+{_LATIN_WS}++){_MARK}*+"
)
_WIDE_WS = "[\\u1680-\\u3000]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it.

    Common parts inside a conditional branch are not shared by the optimizer, so a
    costly decode used twice would run twice.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(**columns: Column) -> Column:
    """The columns as the output of a one-row generator.

    A filter on a computed column is pushed down by writing its expression out below,
    so costly expressions would run once more for every such filter. Filters stop above
    a generator, and the columns are worked out exactly once.
    """
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def _edged(text: Column, chars: str) -> Column:
    return reduce(or_, [end(text, F.lit(c)) for c in chars for end in (F.startswith, F.endswith)])


def trim_whitespace(text: Column) -> Column:
    # trimming from the right goes through the whole text: it is left out where nothing is to be trimmed
    return F.when(_edged(text, C.WHITESPACE), F.btrim(text, F.lit(C.WHITESPACE))).otherwise(text)


def remove_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, f"{C.WS}+", "")


def split_words(text: Column) -> Column:
    """Whitespace-separated words of a text, none of them empty."""
    trimmed = trim_whitespace(text)
    return bind(
        trimmed,
        lambda t: F.when(t == "", F.array().cast("array<string>"))
        # one long word is told by one look-up a character, without a split
        .when(t.rlike("^[!-~]++\\z"), F.array(t))
        .otherwise(F.split(t, f"{C.WS}+")),
    )


def strip_punctuation(word: Column) -> Column:
    # as for whitespace: a long word is gone through only where there is something to strip
    bare = (F.octet_length(word) > 64) & ~_edged(word, C.PUNCTUATION)
    return F.when(bare, word).otherwise(F.btrim(word, F.lit(C.PUNCTUATION)))


def split_cores(trimmed: Column) -> Column:
    """Words of an already trimmed text, edge punctuation removed in the same pass.

    A word made only of marks stays as an empty string, so sizes and positions
    equal those of :func:`split_words`.
    """
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(strip_punctuation(trimmed), _WORD_GAP)
    )


def spaced_cores(trimmed: Column) -> Column:
    """The words of :func:`split_cores`, each behind a line feed, as one text; no core holds whitespace.

    The marks at both ends of the text are those of a gap, and the gap at its end is taken off again.
    """
    gaps = F.concat(F.lit("\n"), trimmed, F.lit("\n"))
    one_feed = F.when(trimmed.rlike(_WIDE_WS), F.regexp_replace(gaps, _WORD_GAP, "\n")).otherwise(
        F.regexp_replace(gaps, _LATIN_GAP, "\n")
    )
    return F.when(trimmed == "", "").otherwise(F.regexp_replace(one_feed, "\n\\z", ""))


def count_letters(word: Column) -> Column:
    return F.length(F.regexp_replace(word, "\\P{L}+", ""))


def has_letters(word: Column, at_least: int) -> Column:
    return word.rlike(f"^(?:\\P{{L}}*+\\p{{L}}){{{at_least}}}")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_pair_chars(text: Column) -> Column:
    """Characters of the ``%`` pairs in a text, three for each; a run of pairs is one match."""
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"(?:{HEX_PAIR})++", ""))


def has_matches(text: Column, pattern: str, at_least: int) -> Column:
    """``count_matches(text, pattern) >= at_least``, read no further than it takes."""
    return text.rlike(f"^(?s:(?>.*?(?:{pattern}))){{{at_least}}}")


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def count_listed(text: Column, listed_class: str) -> Column:
    """Characters of a text that are in a class of listed ones, runs of them taken at once."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{listed_class}++", ""))


def extra_bytes(text: Column) -> Column:
    """Upper bound on the number of non-ASCII characters, without a decode."""
    return F.octet_length(text) - F.length(text)


def printable_share(data: Column) -> Column:
    """Share of bytes that are printable ASCII or tab..carriage return; NULL if empty."""
    # one Latin-1 character per byte, so both lengths come from the one decode
    return bind(
        F.decode(data, "iso-8859-1"),
        lambda latin: F.try_divide(
            F.length(F.regexp_replace(latin, _NOT_PRINTABLE, "")),
            F.length(latin),
        ),
    )


def is_printable(data: Column) -> Column:
    return F.coalesce(printable_share(data) > C.PRINTABLE_SHARE, F.lit(False))


# The digits of one printable byte, and those of any byte.
_BITS = ("0(?:1[01]{6}+(?<!1111111)|01[01]{5}+|0001(?:001|01[01]|10[01]))", "[01]{8}+")
_HEX = (f"[2-6]{HEX_DIGIT}|7{listed('0-9a-eA-E')}|0[9a-dA-D]", f"{HEX_DIGIT}{{2}}+")


def _digits_printable(digits: Column, byte: tuple[str, str], width: int) -> Column:
    # matches follow each other without a gap, so that they begin where bytes begin
    rest = F.octet_length(F.regexp_replace(digits, f"(?:{byte[0]})++|({byte[1]})", "$1"))
    size = F.octet_length(digits)
    return F.when(size % width == 0, F.try_divide((size - rest) / width, size / width) > C.PRINTABLE_SHARE)


def bits_printable(digits: Column) -> Column:
    """:func:`is_printable` of the bytes of a string known to hold 0s and 1s only, read off the digits."""
    return F.coalesce(_digits_printable(digits, _BITS, 8), F.lit(False))


def hex_printable(digits: Column) -> Column:
    """The same of a string known to hold hex digits only."""
    return F.coalesce(_digits_printable(digits, _HEX, 2), F.lit(False))


def decode_base64(text: Column) -> Column:
    """BINARY, or NULL unless the text is padded, well-formed base64.

    The test in front leaves nothing the decoder could refuse.
    """
    return F.when(
        (F.length(text) % 4 == 0) & text.rlike(_BASE64_TEXT), F.unbase64(text)
    )


def decode_hex(text: Column) -> Column:
    """BINARY, or NULL unless the text is an even number of hex digits."""
    return F.when(
        (F.length(text) % 2 == 0) & text.rlike(f"^{HEX_DIGIT}++\\z"), F.unhex(text)
    )


def decode_binary_digits(text: Column) -> Column:
    """Bytes of a string of 0s and 1s, as hex pairs turned to BINARY; else NULL."""
    # seven bytes at a time, which fit a signed number
    pieces = F.regexp_extract_all(text, F.lit("[01]{1,56}+"), F.lit(0))
    as_hex = F.transform(pieces, lambda p: F.lpad(F.conv(p, 2, 16), F.shiftright(F.octet_length(p), 2), "0"))
    return F.when(
        (F.length(text) % 8 == 0) & text.rlike("^[01]++\\z"), F.unhex(F.array_join(as_hex, ""))
    )


def decode_url(text: Column) -> Column:
    """Percent-decoded text; a plus sign and a bare percent sign stay as they are."""
    escaped = F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25")
    return F.try_url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))


def url_decodes_to_more(text: Column, chars: int) -> Column:
    """Whether the percent-decoded text has more than ``chars`` characters."""
    # a decoded character comes from four pairs at most, or from one of four bytes, so that of a long text
    # no decoding is needed
    return (F.octet_length(text) > 12 * (chars + 1)) | (F.length(decode_url(text)) > chars)


def _escape_remainder(text: Column) -> Column:
    return F.regexp_replace(text, ANY_ESCAPE, "")


def is_escape_decodable(text: Column) -> Column:
    return text.rlike(f"^(?:[^\\\\]++|{ANY_ESCAPE})*+\\z")


def escapes_decode_to_more(text: Column, chars: int) -> Column:
    """Whether the text, its escapes decoded, has more than ``chars`` characters; not TRUE if malformed."""
    # ten characters are one at least, unless line breaks vanish: a long text need only be well formed
    long = (F.octet_length(text) > 10 * (chars + 1)) & ~text.contains("\\\n")
    return F.when(long, is_escape_decodable(text)).otherwise(decoded_escape_length(text) > chars)


def decoded_escape_length(text: Column) -> Column:
    """Characters the text has once its backslash escapes are decoded; NULL if malformed.

    Plain text counts as its UTF-8 bytes, an unknown escape stays as written and
    an escaped line break vanishes.
    """
    rest = _escape_remainder(text)
    known = F.regexp_count(
        text,
        F.lit(ANY_ESCAPE.replace("[^uUxN0-7]", "[^uUxN0-7\\n]")),
    )
    unknown = _unknown_escapes(text)
    # an unknown escape is one match already counted; it keeps its backslash and
    # every byte of the character after it
    kept = F.octet_length(F.array_join(unknown, "")) - F.size(unknown)
    return F.when(~rest.contains("\\"), F.octet_length(rest) + known + kept)


def _unknown_escapes(text: Column) -> Column:
    unknown = "\\\\[^uUxN0-7\\\\'\"abfnrtv\\n]"
    tokens = F.regexp_extract_all(text, F.lit(f"({ANY_ESCAPE})"), F.lit(1))
    return F.when(
        text.rlike(unknown), F.filter(tokens, lambda t: t.rlike(f"^{unknown}\\z"))
    ).otherwise(F.array().cast("array<string>"))


def _escape_code_point(token: Column) -> Column:
    kind = F.substring(token, 2, 1)
    return (
        F.when(kind.isin("u", "U", "x"), F.conv(F.substring(token, 3, 8), 16, 10))
        .when(kind.rlike("[0-7]"), F.conv(F.substring(token, 2, 3), 8, 10))
        .when(kind.isin("\\", "'", '"'), F.ascii(kind).cast("string"))
        .otherwise(
            F.element_at(
                F.create_map(
                    *[
                        F.lit(v)
                        for pair in zip("abfnrtv", ("7", "8", "12", "10", "13", "9", "11"))
                        for v in pair
                    ]
                ),
                kind,
            )
        )
        .cast("int")
    )


def escapes_decode_printable(text: Column) -> Column:
    """True when the escape-decoded text, as UTF-8, is mostly printable ASCII.

    False when it is not, or when an escape is malformed. Text outside escapes is
    read byte by byte, so each of its non-ASCII bytes becomes two bytes again.
    """
    rest = _escape_remainder(text)
    tokens = F.regexp_extract_all(text, F.lit(f"({ANY_ESCAPE})"), F.lit(1))
    unknown = _unknown_escapes(text)
    code_points = F.transform(
        F.filter(
            tokens, lambda t: t.rlike("^\\\\[uUx0-7\\\\'\"abfnrtv]")
        ),
        _escape_code_point,
    )
    plain = F.concat(rest, F.array_join(unknown, ""))
    ascii_only = F.regexp_replace(plain, "[^\\x00-\\x7f]+", "")
    plain_bytes = F.length(ascii_only) + 2 * (F.octet_length(plain) - F.length(ascii_only))
    plain_good = F.length(F.regexp_replace(ascii_only, "[^\\x20-\\x7e\\x09-\\x0d]+", ""))
    widths = F.transform(
        code_points,
        lambda p: F.when(p < 0x80, 1)
        .when(p < 0x800, 2)
        .when(p.between(0xD800, 0xDFFF), 0)
        .when(p < 0x10000, 3)
        .otherwise(4),
    )
    good = F.size(
        F.filter(code_points, lambda p: p.between(32, 126) | p.between(9, 13))
    )
    total = F.aggregate(widths, F.lit(0), lambda a, w: a + w) + plain_bytes
    share = F.try_divide(plain_good + good, total)
    return F.coalesce(
        ~rest.contains("\\") & (share > C.PRINTABLE_SHARE), F.lit(False)
    )


def starts_backwards(text: Column, starts: tuple[str, ...]) -> Column:
    """Whether the text, read from its end in lower case, begins with one of ``starts``."""
    endings: dict[int, list[str]] = {}
    for start in starts:
        endings.setdefault(len(start), []).append(start[::-1])
    tests = [F.lower(F.right(text, F.lit(n))).isin(*ends) for n, ends in endings.items()]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def count_case_changes(word: Column) -> Column:
    """Neighbouring letters of which exactly one is lower case."""
    return F.regexp_count(word, F.lit(_CASE_CHANGE))


def is_title_case(word: Column) -> Column:
    """Every cased run starts with a capital and goes on in lower case."""
    return ~word.rlike(_NOT_TITLE)


def label_name(label: Column) -> Column:
    return F.when(label == 1, "JAILBREAK").when(label == 0, "BENIGN")


def label_id(name: Column) -> Column:
    return F.when(name == "JAILBREAK", 1).when(name == "BENIGN", 0)
