"""Personal-data patterns and masks over whole texts.

A text is cut into gaps and matches by one regex pass and put together again, so a
mask needs no character positions and costs linear time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import charsets as C
from textguard.functions import primitives as P

# --- fixed values ---------------------------------------------------------
# Alternatives in the order they are tried at a position. No repeat has an upper bound
# that a text could outgrow. A mailbox is entered only where its run of characters starts,
# or right after the match before, and gives nothing back, so that time stays linear.
PATTERNS = {
    "EMAIL": r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "IPV4": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "PHONE": r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "SECRET": r"[0-9a-fA-F]{32,}",
    "DIGITS": r"[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{9,}",
}
REDACTED = "[redacted]"
# --------------------------------------------------------------------------

ANY_PII = "|".join(f"(?:{p})" for p in PATTERNS.values())
_NO_EMAIL = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "EMAIL")


def _blank(gap: Column) -> Column:
    return gap.rlike(f"^{C.WS}*+\\z")


def _by_email(text: Column, build) -> Column:
    """A text without an at sign holds no e-mail: use the cheaper pattern there."""
    return F.when(text.contains("@"), build(ANY_PII)).otherwise(build(_NO_EMAIL))


def find_matches(text: Column) -> Column:
    """ARRAY<STRING> of the matched pieces in order of appearance."""
    return _by_email(text, lambda p: F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)))


def find_gaps(text: Column) -> Column:
    """ARRAY<STRING> of the text around the matches; one more than there are matches."""
    return _by_email(text, lambda p: F.split(text, p))


def match_label(match: Column) -> Column:
    """Type of one matched piece: the first pattern that fits all of it."""
    label = None
    for name, pattern in PATTERNS.items():
        fits = match.rlike(f"^(?:{pattern})\\z")
        label = F.when(fits, name) if label is None else label.when(fits, name)
    return label


def tidy(text: Column) -> Column:
    """One pass of space clean-up around marks."""
    for old, new in ((" ]", "]"), ("[ ", "["), ("  ", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _mask_together(text: Column) -> Column:
    def join(gaps: Column) -> Column:
        inner = F.filter(
            F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 2, F.lit(0))),
            lambda g: ~_blank(g),
        )
        ends = (F.slice(gaps, F.lit(1), F.lit(1)), F.slice(gaps, F.lit(-1), F.lit(1)))
        return F.array_join(F.concat(ends[0], inner, ends[1]), REDACTED)

    def build(pattern: str) -> Column:
        return F.when(text.rlike(pattern), P.bind(F.split(text, pattern), join)).otherwise(text)

    return _by_email(text, build)


def _mask_typed(text: Column) -> Column:
    def join(found: Column) -> Column:
        gaps, labels = found["gaps"], found["labels"]

        def piece(i: Column) -> Column:
            label, before = F.element_at(labels, i), F.element_at(labels, F.greatest(i - 1, F.lit(1)))
            mark = F.concat(F.lit("["), label, F.lit("]"))
            gap = F.element_at(gaps, i)
            return (
                F.when((i == 1) | ~_blank(gap), F.concat(gap, mark))
                .when(label == before, "")
                .otherwise(mark)
            )

        body = F.transform(F.sequence(F.lit(1), F.size(labels)), piece)
        return F.concat(F.array_join(body, ""), F.element_at(gaps, -1))

    def build(pattern: str) -> Column:
        matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
        found = F.struct(
            F.split(text, pattern).alias("gaps"),
            F.transform(matches, match_label).alias("labels"),
        )
        return F.when(text.rlike(pattern), P.bind(found, join)).otherwise(text)

    return _by_email(text, build)


def mask_pii(text: Column, aggregate: bool = True) -> Column:
    """Masked and tidied text; NULL or empty text gives an empty string.

    ``aggregate`` puts one mark over neighbouring matches of any type; otherwise each
    type keeps its own mark and a new one starts where the type changes. Matches with
    nothing but whitespace between them are neighbours.
    """
    masked = _mask_together(text) if aggregate else _mask_typed(text)
    return F.coalesce(tidy(masked), F.lit(""))


def merge_spans(text: Column, spans: Column, aggregate: bool = True) -> Column:
    """Joins neighbouring spans of a sorted, non-overlapping span array."""

    def starts_new(i: Column) -> Column:
        here, before = F.element_at(spans, i), F.element_at(spans, F.greatest(i - 1, F.lit(1)))
        between = F.substring(text, before["end"] + 1, here["start"] - before["end"])
        apart = ~_blank(between)
        if not aggregate:
            apart = apart | (here["label"] != before["label"])
        return (i == 1) | apart

    index = F.sequence(F.lit(1), F.size(spans))
    first = F.filter(index, starts_new)
    last = F.filter(
        index,
        lambda i: (i == F.size(spans)) | starts_new(F.least(i + 1, F.size(spans))),
    )
    merged = F.zip_with(
        first,
        last,
        lambda a, b: F.struct(
            F.element_at(spans, a)["start"].alias("start"),
            F.element_at(spans, b)["end"].alias("end"),
            F.element_at(spans, a)["label"].alias("label"),
        ),
    )
    return F.when(F.size(spans) > 0, merged).otherwise(spans)


def mask_spans(text: Column, merged: Column, aggregate: bool = True) -> Column:
    """Masks a text by spans from :func:`merge_spans`, offsets in characters from 0.

    In typed mode blank text before a span of another type goes with the mask.
    """

    def piece(i: Column) -> Column:
        here = F.element_at(merged, i)
        begin = F.when(i == 1, 0).otherwise(
            F.element_at(merged, F.greatest(i - 1, F.lit(1)))["end"]
        )
        gap = F.substring(text, begin + 1, here["start"] - begin)
        mark = (
            F.lit(REDACTED)
            if aggregate
            else F.concat(F.lit("["), here["label"], F.lit("]"))
        )
        return F.concat(F.when((i > 1) & _blank(gap), "").otherwise(gap), mark)

    body = F.array_join(F.transform(F.sequence(F.lit(1), F.size(merged)), piece), "")
    tail = F.substring(text, F.element_at(merged, -1)["end"] + 1, F.length(text))
    masked = F.when(F.size(merged) > 0, F.concat(body, tail)).otherwise(text)
    return F.coalesce(tidy(masked), F.lit(""))
