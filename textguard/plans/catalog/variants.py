"""Disguised forms of whole documents, made alike in Spark and in SQL.

The document tables hold next to no disguised text, so the detection queries read each
document in the forms they are about. One scan feeds all forms of a query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import primitives as P
from textguard.plans.catalog.sqltext import words as words_sql
from textguard.sources.tables import read_table, spread

_NIBBLES = "ghijklmnopqrstuv"
_LATIN = "aeopcxyABEKMHOPCTX"
_TWINS = "аеорсхуАВЕКМНОРСТХ"


def _bits(text: Column) -> Column:
    # seven bytes at a time, which fit a signed number
    pieces = F.regexp_extract_all(F.hex(text), F.lit("[0-9A-F]{1,14}+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.lpad(F.conv(p, 16, 2), 4 * F.octet_length(p), "0")), "")


def _bits_sql() -> str:
    out = f"translate(hex(encode(text)), '0123456789ABCDEF', '{_NIBBLES}')"
    for value, letter in enumerate(_NIBBLES):
        out = f"replace({out}, '{letter}', '{value:04b}')"
    return out


def _words(text: Column, build) -> Column:
    return F.array_join(F.transform(P.split_words(text), build), " ")


def _words_sql(expr: str) -> str:
    return f"array_to_string(list_transform({words_sql('text')}, lambda w: {expr}), ' ')"


def _alternate(text: Column) -> Column:
    return F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c, i: F.when(i % 2 == 0, F.when((c >= "A") & (c <= "Z"), F.lower(c)).otherwise(c)).otherwise(
                F.when((c >= "a") & (c <= "z"), F.upper(c)).otherwise(c)
            ),
        ),
        "",
    )


_ALTERNATE_SQL = (
    "array_to_string(list_transform(string_split(text, ''), lambda c, i: CASE WHEN i % 2 = 1 "
    "THEN translate(c, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') "
    "ELSE translate(c, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END), '')"
)

FORMS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "plain": (lambda t: t, "text"),
    "spaced": (
        lambda t: F.concat(F.lit("\u2003\t"), F.translate(t, "\n,", "\u2028\u00a0"), F.lit("\x1c\u3000")),
        "concat('\u2003\t', translate(text, '\n,', '\u2028\u00a0'), '\x1c\u3000')",
    ),
    "base64": (lambda t: F.base64(t.cast("binary")), "to_base64(encode(text))"),
    "hex": (F.hex, "hex(encode(text))"),
    "binary": (_bits, _bits_sql()),
    "percent": (
        lambda t: F.regexp_replace(F.hex(t), "(..)", "%$1"),
        "regexp_replace(hex(encode(text)), '(..)', '%\\1', 'g')",
    ),
    "percent_mixed": (
        lambda t: F.concat(
            F.regexp_replace(F.replace(t, F.lit("o"), F.lit("o%C3%B6")), "([aeiu])", "%6$1"),
            F.lit(" a+b%20c 100%zz"),
        ),
        "concat(regexp_replace(replace(text, 'o', 'o%C3%B6'), '([aeiu])', '%6\\1', 'g'), "
        "' a+b%20c 100%zz')",
    ),
    "escaped": (
        lambda t: F.regexp_replace(F.hex(t), "(..)", "\\\\u00$1"),
        "regexp_replace(hex(encode(text)), '(..)', '\\\\u00\\1', 'g')",
    ),
    "escaped_mixed": (
        lambda t: F.replace(t, F.lit("a"), F.lit("\\u0061")),
        "replace(text, 'a', '\\u0061')",
    ),
    "zero_width": (
        lambda t: F.regexp_replace(t, f"({P.listed('A-Za-z')}{{3}})", "$1\u200b"),
        "regexp_replace(text, '([A-Za-z]{3})', '\\1\u200b', 'g')",
    ),
    "look_alike": (
        lambda t: F.translate(t, _LATIN, _TWINS),
        f"translate(text, '{_LATIN}', '{_TWINS}')",
    ),
    "look_alike_o": (lambda t: F.replace(t, F.lit("o"), F.lit("о")), "translate(text, 'o', 'о')"),
    "leet": (lambda t: F.translate(t, "aeiost", "431057"), "translate(text, 'aeiost', '431057')"),
    "leet_o": (lambda t: F.replace(t, F.lit("o"), F.lit("0")), "translate(text, 'o', '0')"),
    "alternating": (_alternate, _ALTERNATE_SQL),
    "reversed": (F.reverse, "reverse(text)"),
    "word_base64": (
        lambda t: _words(t, lambda w: F.base64(w.cast("binary"))),
        _words_sql("to_base64(encode(w))"),
    ),
    "word_hex": (lambda t: _words(t, F.hex), _words_sql("hex(encode(w))")),
    "word_reversed": (lambda t: _words(t, F.reverse), _words_sql("reverse(w)")),
}
# forms of which every document shows what one rule is about
WHOLE_FORMS = (
    "plain",
    "base64",
    "hex",
    "binary",
    "percent",
    "escaped",
    "zero_width",
    "look_alike",
    "reversed",
)
WORD_FORMS = (
    "plain",
    "percent_mixed",
    "zero_width",
    "look_alike_o",
    "leet",
    "leet_o",
    "alternating",
    "word_base64",
    "word_hex",
    "word_reversed",
)


def forms(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """``(msg_id, source, variant, text)`` for every document and form."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "source", "text"))
    listed = F.array(
        *[F.struct(F.lit(n).alias("variant"), FORMS[n][0](F.col("text")).alias("text")) for n in names]
    )
    return docs.select(F.col("doc_id").alias("msg_id"), "source", F.inline(listed))


def forms_sql(*names: str) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id AS msg_id, source, '{n}' AS variant, {FORMS[n][1]} AS text FROM documents"
        for n in names
    )
