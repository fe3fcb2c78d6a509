"""Queries over primitives, whole-text rules, word rules and the report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import charsets as C
from textguard.functions import primitives as P
from textguard.functions import whole_text as W
from textguard.functions import words as WD
from textguard.operators import obfuscation as O
from textguard.plans.catalog import sqltext as Q
from textguard.plans.catalog.registry import register
from textguard.plans.catalog.variants import WHOLE_FORMS, WORD_FORMS, forms, forms_sql
from textguard.sources.tables import read_table

Build = Callable[[Column], Column]


def _per_text(name: str, form: str, columns: dict[str, tuple[Build, str]]) -> None:
    """One row per document of one form, with the given columns."""
    sql = ", ".join(f"{s} AS {alias}" for alias, (_, s) in columns.items())
    register(name, f"SELECT msg_id, {sql} FROM ({forms_sql(form)})")(
        lambda spark, folder: forms(spark, folder, form).select(
            "msg_id", *[build(F.col("text")).alias(alias) for alias, (build, _) in columns.items()]
        )
    )


_SQL_WORDS = Q.words("text")


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


_per_text(
    "trim_whitespace",
    "spaced",
    {
        "digest": (lambda t: _md5(P.trim_whitespace(t)), f"md5({Q.trim('text')})"),
        "chars": (lambda t: F.length(P.trim_whitespace(t)), f"length({Q.trim('text')})"),
    },
)
_per_text(
    "remove_whitespace",
    "spaced",
    {"digest": (lambda t: _md5(P.remove_whitespace(t)), f"md5({Q.squeeze('text')})")},
)
_per_text(
    "split_words",
    "spaced",
    {
        "n_words": (lambda t: F.size(P.split_words(t)), f"len({_SQL_WORDS})"),
        "digest": (lambda t: _md5(F.array_join(P.split_words(t), "|")), f"md5(array_to_string({_SQL_WORDS}, '|'))"),
    },
)
_per_text(
    "strip_punctuation",
    "plain",
    {
        "digest": (lambda t: _md5(F.array_join(F.transform(P.split_words(t), P.strip_punctuation), "|")),
            f"md5(array_to_string(list_transform({_SQL_WORDS}, lambda w: {Q.core('w')}), '|'))",
        )
    },
)
_per_text("count_letters", "plain", {"letters": (lambda t: P.count_letters(t), Q.letters("text"))})
_per_text(
    "printable_share",
    "plain",
    {
        "share": (lambda t: F.round(P.printable_share(t.cast("binary")), 9),
            f"round({Q.printable_hex('hex(encode(text))')}, 9)",
        )
    },
)
_per_text(
    "base64_decode",
    "word_base64",
    {
        "decoded": (lambda t: F.size(F.array_compact(F.transform(P.split_words(t), P.decode_base64))),
            f"len(list_filter({_SQL_WORDS}, lambda w: ({Q.base64_hex('w')}) IS NOT NULL))",
        ),
        "digest": (lambda t: F.md5(
                F.array_join(
                    F.transform(P.split_words(t), lambda w: F.hex(P.decode_base64(w))), "|"
                ).cast("binary")
            ),
            "md5(array_to_string(list_filter(list_transform("
            f"{_SQL_WORDS}, lambda w: {Q.base64_hex('w')}), lambda h: h IS NOT NULL), '|'))",
        ),
    },
)
_per_text(
    "hex_decode",
    "word_hex",
    {
        "digest": (lambda t: F.md5(
                F.array_join(F.transform(P.split_words(t), lambda w: F.hex(P.decode_hex(w))), "|").cast(
                    "binary"
                )
            ),
            "md5(array_to_string(list_filter(list_transform("
            f"{_SQL_WORDS}, lambda w: {Q.hex_hex('w')}), lambda h: h IS NOT NULL), '|'))",
        )
    },
)
register(
    "binary_digits_decode",
    "SELECT doc_id AS msg_id, md5(hex(encode(text))) AS digest FROM documents",
)(
    lambda spark, folder: forms(spark, folder, "binary").select(
        "msg_id", _md5(F.hex(P.decode_binary_digits(F.col("text")))).alias("digest")
    )
)
_per_text(
    "url_decode",
    "percent_mixed",
    {"digest": (lambda t: _md5(P.decode_url(t)), "md5(url_decode(text))")},
)
register(
    "unicode_escape_length",
    "SELECT doc_id AS msg_id, octet_length(encode(text))::BIGINT AS chars FROM documents",
)(
    lambda spark, folder: forms(spark, folder, "escaped_mixed").select(
        "msg_id", P.decoded_escape_length(F.col("text")).cast("bigint").alias("chars")
    )
)
_per_text(
    "count_pattern_matches",
    "percent_mixed",
    {
        "pairs": (lambda t: P.count_matches(t, P.HEX_PAIR),
            "len(regexp_extract_all(text, '%[0-9a-fA-F]{2}'))",
        )
    },
)
_per_text(
    "count_listed_characters",
    "look_alike",
    {
        "look_alikes": (lambda t: P.count_chars(t, C.LOOK_ALIKES), Q.chars_of("text", C.LOOK_ALIKES)),
        "leet": (lambda t: P.count_chars(t, C.LEET), Q.chars_of("text", C.LEET)),
    },
)
_per_text(
    "reversed_start_test",
    "reversed",
    {
        "hit": (lambda t: P.starts_backwards(t, C.REVERSED_TEXT_STARTS),
            Q.starts_backwards("text", C.REVERSED_TEXT_STARTS),
        )
    },
)
_per_text(
    "count_case_changes",
    "alternating",
    {"changes": (lambda t: P.count_case_changes(t), Q.case_changes("text"))},
)


@register(
    "label_names",
    """SELECT name, CASE name WHEN 'JAILBREAK' THEN 1 WHEN 'BENIGN' THEN 0 END AS label, n
       FROM (SELECT CASE toxic WHEN 1 THEN 'JAILBREAK' WHEN 0 THEN 'BENIGN' END AS name,
                    count(*) AS n FROM labels GROUP BY ALL)""",
)
def label_names(spark, folder):
    named = read_table(spark, folder, "labels").select(
        P.label_name(F.col("toxic")).alias("name")
    )
    counted = named.groupBy("name").agg(F.count("*").alias("n"))
    return counted.select("name", P.label_id(F.col("name")).alias("label"), "n")


# --- whole-text rules, each on plain text and on its own disguise ---------
_RULE_FORMS = {
    "whole_text_base64": ("plain", "base64"),
    "whole_text_hex": ("plain", "hex"),
    "whole_text_binary": ("plain", "binary"),
    "whole_text_url_encoded": ("percent", "percent_mixed"),
    "whole_text_unicode_escapes": ("escaped", "escaped_mixed"),
    "whole_text_invisible_chars": ("plain", "zero_width"),
    "whole_text_char_swaps": ("look_alike_o", "look_alike"),
    "whole_text_reversed": ("plain", "reversed"),
}


def _whole_rule(kind: str, names: tuple[str, ...]) -> None:
    sql = f"""SELECT msg_id, variant, length(t) >= 10 AND {Q.whole_rules('t')[kind]} AS hit
              FROM (SELECT *, {Q.trim('text')} AS t FROM ({forms_sql(*names)}))"""

    @register(kind, sql)
    def query(spark, folder):
        trimmed = forms(spark, folder, *names).withColumn("t", P.trim_whitespace(F.col("text")))
        long_enough = F.length("t") >= C.MIN_WHOLE_CHARS
        return trimmed.select(
            "msg_id", "variant", (long_enough & W.RULES[kind](F.col("t"))).alias("hit")
        )


for _kind, _names in _RULE_FORMS.items():
    _whole_rule(_kind, _names)


@register(
    "whole_text_types",
    f"""SELECT source, variant, coalesce(whole, 'none') AS whole_type, count(*) AS n
        FROM (SELECT source, variant, {Q.whole_label('t')} AS whole
              FROM (SELECT *, {Q.trim('text')} AS t FROM ({forms_sql(*WHOLE_FORMS)})))
        GROUP BY ALL""",
)
def whole_text_types(spark, folder):
    """Per source, how much of each disguise is caught, and as what."""
    label = W.whole_text_label(F.col("t"), length=F.col("chars"))
    return (
        forms(spark, folder, *WHOLE_FORMS)
        .select("source", "variant", P.trim_whitespace(F.col("text")).alias("t"))
        .withColumn("chars", F.length("t"))
        .select("source", "variant", F.coalesce(label, F.lit("none")).alias("whole_type"))
        .groupBy("source", "variant", "whole_type")
        .agg(F.count("*").alias("n"))
    )


# --- word rules -----------------------------------------------------------
_WORD_RULE_FORMS = {
    "binary": "binary",
    "base64": "word_base64",
    "hex": "word_hex",
    "url_encoded": "percent_mixed",
    "unicode_escapes": "escaped_mixed",
    "leetspeak": "leet_o",
    "invisible_chars": "zero_width",
    "char_swaps": "look_alike_o",
    "reversed": "plain",
    "spaced_text": "plain",
    "alternating_case": "alternating",
}


def _word_rule(kind: str, form: str) -> None:
    # spaced text is about phrases: there the whole trimmed text is the word
    phrase = kind == "spaced_text"
    items = f"[{Q.core('text')}]" if phrase else (
        f"list_transform({_SQL_WORDS}, lambda w: {Q.core('w')})"
    )
    sql = f"""
        WITH items AS (SELECT msg_id, unnest({items}) AS w FROM ({forms_sql(form)})),
        vocabulary AS (SELECT w, length(w) >= 3 AND {Q.word_rules('w')[kind]} AS hit
                       FROM (SELECT DISTINCT w FROM items))
        SELECT msg_id, count(*) AS n_words, count(*) FILTER (hit) AS hits
        FROM items JOIN vocabulary USING (w) GROUP BY msg_id"""

    @register(f"word_{kind}", sql)
    def query(spark, folder):
        cores = (
            F.array(P.strip_punctuation(F.col("text")))
            if phrase
            else F.transform(P.split_words(F.col("text")), P.strip_punctuation)
        )
        rule = WD.RULES[kind]
        # both counts from one split, which the filter does not write out again
        counts = P.bind(
            cores,
            lambda found: F.struct(
                F.size(found).cast("bigint").alias("n_words"),
                F.size(F.filter(found, lambda c: (F.length(c) >= 3) & rule(c))).cast("bigint").alias("hits"),
            ),
        )
        counted = forms(spark, folder, form).select("msg_id", P.settled(_counts=counts))
        return counted.filter("_counts.n_words > 0").select("msg_id", "_counts.n_words", "_counts.hits")


for _kind, _form in _WORD_RULE_FORMS.items():
    _word_rule(_kind, _form)


@register(
    "word_checked_filter",
    f"""SELECT msg_id, len(ws) AS n_words,
               len(list_filter(ws, lambda w: {Q.letters('w')} >= 3)) AS checked
        FROM (SELECT msg_id, {_SQL_WORDS} AS ws FROM ({forms_sql('plain')}))""",
)
def word_checked_filter(spark, folder):
    return (
        forms(spark, folder, "plain")
        .withColumn("ws", P.split_words(F.col("text")))
        .select(
            "msg_id",
            F.size("ws").alias("n_words"),
            F.size(F.filter("ws", WD.is_checked)).alias("checked"),
        )
    )


@register(
    "word_types",
    f"""WITH {Q.audit(forms_sql(*WORD_FORMS))}
        SELECT variant, CASE WHEN checked THEN coalesce(enc, 'clean') ELSE 'unchecked' END AS encoding,
               count(*) AS n FROM audit GROUP BY ALL""",
)
def word_types(spark, folder):
    """Words per form and label, through the marks the report is made from."""
    marks = forms(spark, folder, *WORD_FORMS).select("variant", WD.text_marks(P.trim_whitespace(F.col("text"))).alias("m"))
    names = {C.UNCHECKED_MARK: "unchecked", C.CLEAN_MARK: "clean"}
    names |= {mark: kind for kind, mark in C.WORD_MARKS.items()}
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    counts = F.array(
        *[
            F.struct(
                F.lit(mark).alias("mark"),
                (F.length("m") - F.length(F.replace("m", F.lit(mark), F.lit("")))).alias("n"),
            )
            for mark in names
        ]
    )
    return (
        marks.select("variant", F.inline(counts))
        .groupBy("variant", "mark")
        .agg(F.sum("n").alias("n"))
        .filter("n > 0")
        .select("variant", F.element_at(table, F.col("mark")).alias("encoding"), "n")
    )


# --- report ---------------------------------------------------------------
_REPORT_FORMS = ("plain", "leet_o", "look_alike_o", "word_base64", "word_reversed", "alternating")


def _reports(spark, folder):
    return O.detect_obfuscation(forms(spark, folder, *_REPORT_FORMS))


def _audited(columns: str) -> str:
    return (
        f"WITH {Q.audit(forms_sql(*_REPORT_FORMS))} "
        f"SELECT msg_id, variant, {columns} FROM per_msg"
    )


def _counts_text(counts: Column) -> Column:
    return F.array_join(
        F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit("="), e["value"])),
        ",",
    )


def _field(name: str) -> Column:
    return F.col(f"report.{name}")


def _run() -> Column:
    return _field("consecutive_encoded_count")


def _run_limit() -> Column:
    return _field("consecutive_threshold_applied")


def _type_limit() -> Column:
    return _field("same_encoding_threshold_applied")


def _n_words() -> Column:
    return _field("total_words_in_message")


def _counts() -> Column:
    return _field("encoding_counts")


def _by_words() -> Column:
    return ~_field("whole_text_obfuscation")


def _told(name: str, sql: str, **columns: Callable[[], Column]) -> None:
    """Fields of the report for every message; one caught as a whole has none of its words judged."""
    register(name, _audited(sql))(
        lambda spark, folder: _reports(spark, folder).select(
            "msg_id", "variant", *[build().alias(a) for a, build in columns.items()]
        )
    )


_RUN_SQL = "CASE WHEN whole IS NULL THEN run ELSE 0 END"
_COUNTS_SQL = "CASE WHEN whole IS NULL THEN counts ELSE whole || '=1' END"
_POSITIONS_SQL = "CASE WHEN whole IS NULL THEN positions ELSE '' END"
_RUN_LIMIT_SQL = "CASE WHEN whole IS NULL THEN run_limit ELSE 0 END"
_TYPE_LIMIT_SQL = "CASE WHEN whole IS NULL THEN type_limit ELSE 0 END"
_REASONS_SQL = """CASE WHEN whole IS NULL THEN reasons ELSE
          'Entire text appears to be ' || replace(whole, '_', ' ') || ' encoded' END"""
_CHECKED_SQL = "CASE WHEN whole IS NULL THEN checked ELSE 0 END"
_ENCODED_SQL = "CASE WHEN whole IS NULL THEN encoded ELSE 1 END"

_told("longest_encoded_run", f"{_RUN_SQL} AS longest_run", longest_run=_run)
_told("words_per_encoding", f"{_COUNTS_SQL} AS counts", counts=lambda: _counts_text(_counts()))
_told(
    "encoded_positions",
    f"{_POSITIONS_SQL} AS positions",
    positions=lambda: F.array_join(_field("encoded_word_positions").cast("array<string>"), ","),
)
_told("run_threshold", f"n_words, {_RUN_LIMIT_SQL} AS run_limit", n_words=_n_words, run_limit=_run_limit)
_told(
    "same_encoding_threshold",
    f"n_words, {_TYPE_LIMIT_SQL} AS type_limit",
    n_words=_n_words,
    type_limit=_type_limit,
)
_told(
    "run_flag",
    "whole IS NULL AND run_flag AS flagged",
    flagged=lambda: _by_words() & (_run() >= _run_limit()),
)
_told(
    "same_encoding_flag",
    "whole IS NULL AND type_flag AS flagged",
    flagged=lambda: _by_words() & O.same_type_flag(_counts(), _type_limit()),
)
_told(
    "flag_reasons",
    f"{_REASONS_SQL} AS reasons",
    reasons=lambda: F.array_join(_field("flag_reasons"), ", "),
)
_told(
    "word_totals",
    f"n_words, {_CHECKED_SQL} AS checked, {_ENCODED_SQL} AS encoded",
    n_words=_n_words,
    checked=lambda: _field("total_words_checked_for_obfuscation"),
    encoded=lambda: _field("total_encoded_words"),
)


@register(
    "longest_run_by_window",
    f"""WITH {Q.audit(forms_sql('leet_o'))}
        SELECT msg_id, run AS longest_run FROM per_msg""",
)
def longest_run_by_window(spark, folder):
    return O.longest_runs_by_window(O.word_audit(forms(spark, folder, "leet_o"), wordless=True))


@register(
    "obfuscation_report",
    _audited(
        f"""
        whole IS NOT NULL OR run_flag OR type_flag AS should_flag,
        whole IS NOT NULL AS whole_text_obfuscation,
        whole AS whole_text_encoding_type,
        {_RUN_SQL} AS consecutive_encoded_count,
        {_RUN_LIMIT_SQL} AS consecutive_threshold_applied,
        {_COUNTS_SQL} AS encoding_counts,
        {_TYPE_LIMIT_SQL} AS same_encoding_threshold_applied,
        {_REASONS_SQL} AS flag_reasons,
        n_words AS total_words_in_message,
        {_CHECKED_SQL} AS total_words_checked_for_obfuscation,
        {_ENCODED_SQL} AS total_encoded_words,
        {_POSITIONS_SQL} AS encoded_word_positions"""
    ),
)
def obfuscation_report(spark, folder):
    flat = _reports(spark, folder).select("msg_id", "variant", "report.*")
    return flat.withColumns(
        {
            "encoding_counts": _counts_text(F.col("encoding_counts")),
            "flag_reasons": F.array_join("flag_reasons", ", "),
            "encoded_word_positions": F.array_join(
                F.col("encoded_word_positions").cast("array<string>"), ","
            ),
        }
    )


@register(
    "obfuscation_flag",
    _audited("whole IS NOT NULL OR run_flag OR type_flag AS should_flag"),
)
def obfuscation_flag(spark, folder):
    return O.quick_flag(forms(spark, folder, *_REPORT_FORMS)).select(
        "msg_id", "variant", "should_flag"
    )
