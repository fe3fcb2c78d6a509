"""Rules that look at one word. Each takes the word with edge punctuation removed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import charsets as C
from textguard.functions import marking as MK
from textguard.functions import primitives as P


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_checked(word: Column) -> Column:
    return P.has_letters(word, C.MIN_WORD_LETTERS)


def is_binary_word(core: Column) -> Column:
    return _flag(
        # digits alone, nearly always so, are their bytes
        F.when(core.rlike("^[01]{8,}+\\z"), F.octet_length(core) % 8 == 0).when(
            core.rlike(f"^[01{C.WS[1:-1]}]{{8,}}+\\z"),
            P.bind(F.octet_length(P.remove_whitespace(core)), lambda n: (n >= 8) & (n % 8 == 0)),
        )
    )


def is_base64_word(core: Column) -> Column:
    return _flag(F.when(F.length(core) >= 4, P.is_printable(P.decode_base64(core))))


def is_hex_word(core: Column) -> Column:
    packed = F.regexp_replace(core, f"[{C.WS[1:-1]}:,-]+", "")
    return _flag(
        F.when(
            core.rlike(f"^[0-9a-fA-F{C.WS[1:-1]}:,-]{{8,}}\\z"),
            F.when(F.length(packed) >= 8, P.is_printable(P.decode_hex(packed))),
        )
    )


def is_url_encoded_word(core: Column) -> Column:
    return _flag(
        F.when(
            core.contains("%"),
            F.when(core.rlike(P.HEX_PAIR), P.decode_url(core).rlike("[\\p{L}\\p{N}]")),
        )
    )


def is_unicode_escaped_word(core: Column) -> Column:
    return _flag(
        F.when(
            core.contains("\\"),
            F.when(core.rlike(P.UNICODE_ESCAPE), P.escapes_decode_printable(core)),
        )
    )


def is_leetspeak(core: Column) -> Column:
    return core.rlike(C.LEET_CLASS) & core.rlike("\\p{L}")


def has_invisible(core: Column) -> Column:
    return _flag(F.when(P.extra_bytes(core) > 0, core.rlike(C.INVISIBLE_CLASS)))


def has_look_alike(core: Column) -> Column:
    # one range over both alphabets first: cheaper than 42 single letters
    return _flag(
        F.when(core.rlike("[\\u0370-\\u04ff]"), core.rlike(C.LOOK_ALIKE_CLASS))
    )


def is_reversed_word(core: Column) -> Column:
    return (F.length(core) > 5) & P.starts_backwards(core, C.REVERSED_WORD_STARTS)


def is_spaced_word(core: Column) -> Column:
    return core.contains(" ") & (F.length(F.replace(core, F.lit(" "), F.lit(""))) >= 3)


def is_alternating_case(core: Column) -> Column:
    return _flag(
        F.when(
            F.length(core) > 3,
            F.when(
                (core != F.lower(core))
                & (core != F.upper(core))
                & ~P.is_title_case(core),
                P.count_case_changes(core) > F.length(core) / 3,
            ),
        )
    )


RULES = dict(
    zip(
        C.WORD_TYPES,
        (
            is_binary_word,
            is_base64_word,
            is_hex_word,
            is_url_encoded_word,
            is_unicode_escaped_word,
            is_leetspeak,
            has_invisible,
            has_look_alike,
            is_reversed_word,
            is_spaced_word,
            is_alternating_case,
        ),
    )
)


def core_label(core: Column, names: dict[str, str] | None = None) -> Column:
    """First matching label of a word core, or NULL; ``names`` renames the labels."""
    label = None
    for kind, rule in RULES.items():
        name = names[kind] if names else kind
        test = rule(core)
        label = F.when(test, name) if label is None else label.when(test, name)
    return F.when(F.length(core) >= 3, label)


def word_label(word: Column) -> Column:
    """First matching label of one word as written, or NULL."""
    return core_label(P.strip_punctuation(word))


# Ordinary words, told apart in one test each. Only lower-case or capitalised
# words of Latin letters are looked at, for which just three rules are open:
# - base64 needs a length divisible by four, and up to eight letters it needs every
#   group of four to start below "g", or a decoded byte is 0x80 or more;
# - hex digits that are all letters decode to bytes of 0xAA or more, never printable;
# - reversed needs six letters and one of the endings.
_ORDINARY = (
    "^(?!(?:[A-Za-f].{3}){1,2}\\z|(?:.{4}){3,}+\\z)"
    "(?:[A-Z\\xc0-\\xd6\\xd8-\\xde][a-z\\xdf-\\xf6\\xf8-\\xff]{2,}+"
    "|[a-z\\xdf-\\xf6\\xf8-\\xff]{3,}+)\\z"
)
_ENDINGS = "|".join(start[::-1] for start in C.REVERSED_WORD_STARTS)
_ORDINARY_CLEAN = f"{_ORDINARY}(?<!{_ENDINGS})"
_ORDINARY_REVERSED = f"^(?=.{{6}}){_ORDINARY[1:]}(?<={_ENDINGS})"


def cascade_mark(core: Column) -> Column:
    """Mark of one word from the full cascade."""
    return F.when(
        is_checked(core),
        F.coalesce(core_label(core, C.WORD_MARKS), F.lit(C.CLEAN_MARK)),
    ).otherwise(C.UNCHECKED_MARK)


def word_mark(core: Column) -> Column:
    """Same mark, with ordinary words answered ahead of the cascade."""
    return (
        F.when(F.length(core) < C.MIN_WORD_LETTERS, C.UNCHECKED_MARK)
        .when(core.rlike(_ORDINARY_CLEAN), C.CLEAN_MARK)
        .when(core.rlike(_ORDINARY_REVERSED), C.WORD_MARKS["reversed"])
        .otherwise(cascade_mark(core))
    )


def text_marks(text: Column) -> Column:
    """One mark per whitespace-separated word of a text: unchecked, clean, or that of its label.

    Most words are told at once by tables of characters (:mod:`textguard.functions.marking`); those
    that stay open go through the cascade, one by one.
    """
    opened = f"{MK.OPEN}([^{MK.CLOSE}]*+){MK.CLOSE}"

    def filled(told: Column) -> Column:
        rest = F.transform(F.regexp_extract_all(told, F.lit(opened), F.lit(1)), cascade_mark)
        # what is settled before the first open word, and behind each of them
        known = F.split(told, opened)
        return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), rest), known, lambda mark, marks: F.concat(mark, marks)), "")

    return P.bind(MK.marked(text), lambda told: F.when(told.contains(MK.OPEN), filled(told)).otherwise(told))


def spaced_marks(spaced: Column) -> Column:
    """The same per word of :func:`primitives.spaced_cores`."""
    # a mark before each core keeps the empty ones words, and is stripped again
    return text_marks(F.replace(spaced, F.lit("\n"), F.lit("\n.")))
