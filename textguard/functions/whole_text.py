"""Rules that look at a whole message. Each takes the trimmed text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import charsets as C
from textguard.functions import primitives as P


def _only(text: Column, chars: str) -> Column:
    """Cheap gate: stops at the first character outside the class."""
    return text.rlike(f"^(?:{P.listed(chars)}++|{C.WS}++)++\\z")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _packed_decodes(
    text: Column, chars: str, at_least: int, printable: Callable[[Column], Column]
) -> Column:
    """Text of the given characters and whitespace only, decoding to printable bytes."""
    # nothing else than the characters and whitespace is in the text, and nearly always no whitespace
    packed = F.when(text.rlike(f"^{P.listed(chars)}++\\z"), text).when(
        _only(text, chars), F.regexp_replace(text, f"[^{P.listed(chars)[1:]}+", "")
    )
    return _flag(
        P.bind(packed, lambda p: F.when(F.octet_length(p) >= at_least, printable(p)))
    )


def is_base64_text(text: Column) -> Column:
    return _packed_decodes(text, "A-Za-z0-9+/=", 16, lambda p: P.is_printable(P.decode_base64(p)))


def is_hex_text(text: Column) -> Column:
    return _packed_decodes(text, "0-9a-fA-F", 16, P.hex_printable)


def is_binary_text(text: Column) -> Column:
    return _packed_decodes(text, "01", 32, P.bits_printable)


def _are_printable_digits(digits: Column) -> Column:
    """:func:`is_binary_text` of a text that is known to hold 0s and 1s only."""
    return (F.octet_length(digits) >= 32) & P.bits_printable(digits)


def is_url_encoded_text(text: Column) -> Column:
    visible = F.length(F.replace(text, F.lit(" "), F.lit("")))
    return _flag(
        F.when(
            text.contains("%"),
            F.when(P.count_pair_chars(text) / visible > C.URL_SHARE, P.url_decodes_to_more(text, 5)),
        )
    )


def is_unicode_escaped_text(text: Column) -> Column:
    return _flag(
        F.when(
            text.contains("\\"),
            F.when(P.has_matches(text, P.UNICODE_ESCAPE, 3), P.escapes_decode_to_more(text, 5)),
        )
    )


def has_many_invisibles(text: Column, length: Column | None = None) -> Column:
    length = F.length(text) if length is None else length
    limit = length * C.INVISIBLE_SHARE
    return _flag(
        F.when(
            F.octet_length(text) - length > limit, P.count_listed(text, C.INVISIBLE_CLASS) > limit
        )
    )


def has_many_look_alikes(text: Column, length: Column | None = None) -> Column:
    length = F.length(text) if length is None else length
    limit = length * C.LOOK_ALIKE_SHARE
    return _flag(
        F.when(
            F.octet_length(text) - length > limit, P.count_listed(text, C.LOOK_ALIKE_CLASS) > limit
        )
    )


def is_reversed_text(text: Column, length: Column | None = None) -> Column:
    return _flag(
        ((F.length(text) if length is None else length) > 20) & P.starts_backwards(text, C.REVERSED_TEXT_STARTS)
    )


RULES = dict(
    zip(
        C.WHOLE_TYPES,
        (
            is_base64_text,
            is_hex_text,
            is_binary_text,
            is_url_encoded_text,
            is_unicode_escaped_text,
            has_many_invisibles,
            has_many_look_alikes,
            is_reversed_text,
        ),
    )
)


# rules about texts of certain digits only, all of them base64's
_PACKED = (is_base64_text, is_hex_text, is_binary_text)
# rules that take the text's length, where it is known, as a second argument
_BY_LENGTH = (has_many_invisibles, has_many_look_alikes, is_reversed_text)


def whole_text_label(trimmed: Column, reversed_rule: bool = True, length: Column | None = None) -> Column:
    """First matching whole-text label of a trimmed text, or NULL; ``length`` is its number of characters.

    ``reversed_rule=False`` leaves out the last rule, which also catches ordinary
    sentences that end in one of its letter pairs.
    """
    rules = list(RULES.items())
    if not reversed_rule:
        rules = rules[:-1]
    length = F.length(trimmed) if length is None else length
    # a text of digits only begins with them: the long tests are for few texts
    opening = _only(F.substring(trimmed, 1, 64), "A-Za-z0-9+/=")
    label = None
    for name, rule in rules:
        test = rule(trimmed, length) if rule in _BY_LENGTH else rule(trimmed)
        test = opening & test if rule in _PACKED else test
        label = F.when(test, name) if label is None else label.when(test, name)
    # 0s and 1s alone are never printable as base64 or hex, and no later rule is about them
    digits = F.when(_are_printable_digits(trimmed), "whole_text_binary")
    return F.when(length >= C.MIN_WHOLE_CHARS, F.when(opening & trimmed.rlike("^[01]++\\z"), digits).otherwise(label))
