"""SQL fragments the equivalent queries are put together from.

Written from the rules, not from the Column forms: decoding is judged on hex pairs,
reversal on reversed strings, case on lists of letters.
"""

from __future__ import annotations

from textguard.functions import charsets as C

WS = (
    "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)
PUNCT = C.PUNCTUATION.replace("'", "''")



def trim(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(text: str) -> str:
    return f"regexp_replace({text}, '{WS}+', '', 'g')"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda x: x <> '')"


def core(word: str) -> str:
    return f"trim({word}, '{PUNCT}')"


def letters(text: str) -> str:
    return f"length(regexp_replace({text}, '[^\\p{{L}}]', '', 'g'))"


def printable_hex(pairs: str) -> str:
    """Share of printable bytes of a string of upper-case hex pairs; NULL when empty."""
    good = (
        f"len(list_filter(regexp_extract_all({pairs}, '..'), lambda p: "
        "(p BETWEEN '20' AND '7E') OR (p BETWEEN '09' AND '0D')))"
    )
    return f"({good} / nullif(length({pairs}) / 2, 0))"


def base64_hex(text: str) -> str:
    """Decoded bytes as hex, NULL unless padded well-formed base64."""
    return (
        f"CASE WHEN length({text}) % 4 = 0 AND regexp_matches({text}, '^[A-Za-z0-9+/]*={{0,2}}$') "
        f"THEN hex(try(from_base64({text}))) END"
    )


def hex_hex(text: str) -> str:
    return (
        f"CASE WHEN length({text}) % 2 = 0 AND regexp_matches({text}, '^[0-9a-fA-F]+$') "
        f"THEN upper({text}) END"
    )


def binary_share(text: str) -> str:
    """Share of printable bytes of a string of binary digits."""
    return (
        f"(len(list_filter(regexp_extract_all({text}, '[01]{{8}}'), lambda b: "
        "(b BETWEEN '00100000' AND '01111110') OR (b BETWEEN '00001001' AND '00001101'))) "
        f"/ nullif(length({text}) / 8, 0))"
    )


def chars_of(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


def starts_backwards(text: str, starts: tuple[str, ...]) -> str:
    return (
        "(" + " OR ".join(f"starts_with(lower(reverse({text})), '{s}')" for s in starts) + ")"
    )


def case_changes(text: str) -> str:
    """Neighbouring letters of which one is lower case and the other is not."""
    pairs = f"list_zip(string_split({text}, '')[:-2], string_split({text}, '')[2:])"
    return (
        f"len(list_filter({pairs}, lambda p: regexp_matches(p[1], '^\\p{{L}}$') AND "
        "regexp_matches(p[2], '^\\p{L}$') AND "
        "regexp_matches(p[1], '^\\p{Ll}$') <> regexp_matches(p[2], '^\\p{Ll}$')))"
    )


def title_case(text: str) -> str:
    pairs = f"list_zip(string_split(' ' || {text}, '')[:-2], string_split({text}, ''))"
    return (
        f"(len(list_filter({pairs}, lambda p: "
        "(regexp_matches(p[2], '^\\p{Ll}$') AND NOT regexp_matches(p[1], '^\\p{L}$')) OR "
        "(regexp_matches(p[2], '^\\p{Lu}$') AND regexp_matches(p[1], '^\\p{L}$')))) = 0)"
    )


_ESC = "\\\\u[0-9a-fA-F]{4}|\\\\U[0-9a-fA-F]{8}"


def whole_rules(t: str) -> dict[str, str]:
    """Whole-text rules over a trimmed text. The escape rule covers ``\\uXXXX`` alone."""
    packed = squeeze(t)
    pairs = f"len(regexp_extract_all({t}, '%[0-9a-fA-F]{{2}}'))"
    escapes = f"len(regexp_extract_all({t}, '{_ESC}'))"
    return {
        "whole_text_base64": (
            f"length({packed}) >= 16 AND coalesce({printable_hex(base64_hex(packed))} > 0.85, false)"
        ),
        "whole_text_hex": (
            f"length({packed}) >= 16 AND coalesce({printable_hex(hex_hex(packed))} > 0.85, false)"
        ),
        "whole_text_binary": (
            f"regexp_matches({packed}, '^[01]+$') AND length({packed}) >= 32 AND "
            f"length({packed}) % 8 = 0 AND coalesce({binary_share(packed)} > 0.85, false)"
        ),
        "whole_text_url_encoded": (
            f"{pairs} > 0 AND coalesce({pairs} * 3 / nullif(length(replace({t}, ' ', '')), 0) > 0.3, "
            f"false) AND coalesce(length(try(url_decode({t}))) > 5, false)"
        ),
        "whole_text_unicode_escapes": (
            f"{escapes} >= 3 AND "
            f"octet_length(encode(regexp_replace({t}, '{_ESC}', '', 'g'))) + {escapes} > 5"
        ),
        "whole_text_invisible_chars": f"{chars_of(t, C.INVISIBLES)} > length({t}) * 0.1::DOUBLE",
        "whole_text_char_swaps": f"{chars_of(t, C.LOOK_ALIKES)} > length({t}) * 0.3::DOUBLE",
        "whole_text_reversed": (
            f"length({t}) > 20 AND {starts_backwards(t, C.REVERSED_TEXT_STARTS)}"
        ),
    }


def whole_label(t: str) -> str:
    cases = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in whole_rules(t).items())
    return f"CASE WHEN length({t}) < 10 THEN NULL {cases} END"


def word_rules(w: str) -> dict[str, str]:
    """Word rules over a word core. The escape rule covers ``\\u0061`` alone."""
    packed = f"regexp_replace({w}, '[{WS[1:-1]}:,-]', '', 'g')"
    decoded = f"replace({w}, '\\u0061', 'a')"
    plain = f"regexp_replace({decoded}, '[^\\x{{00}}-\\x{{7f}}]', '', 'g')"
    good = f"length(regexp_replace({decoded}, '[^\\x{{20}}-\\x{{7e}}]', '', 'g'))"
    size = f"(length({plain}) + 2 * (octet_length(encode({decoded})) - length({plain})))"
    leet = "[0134578@!$+|()<>]"
    return {
        "binary": (
            f"regexp_matches({squeeze(w)}, '^[01]+$') AND length({squeeze(w)}) % 8 = 0 "
            f"AND length({squeeze(w)}) >= 8"
        ),
        "base64": (
            f"length({w}) >= 4 AND coalesce({printable_hex(base64_hex(w))} > 0.85, false)"
        ),
        "hex": (
            f"length({packed}) >= 8 AND coalesce({printable_hex(hex_hex(packed))} > 0.85, false)"
        ),
        "url_encoded": (
            f"regexp_matches({w}, '%[0-9a-fA-F]{{2}}') AND "
            f"coalesce(regexp_matches(try(url_decode({w})), '[\\p{{L}}\\p{{N}}]'), false)"
        ),
        "unicode_escapes": f"contains({w}, '\\u0061') AND {good} / {size} > 0.85",
        "leetspeak": f"regexp_matches({w}, '{leet}') AND regexp_matches({w}, '\\p{{L}}')",
        "invisible_chars": f"{chars_of(w, C.INVISIBLES)} > 0",
        "char_swaps": f"{chars_of(w, C.LOOK_ALIKES)} > 0",
        "reversed": f"length({w}) > 5 AND {starts_backwards(w, C.REVERSED_WORD_STARTS)}",
        "spaced_text": f"contains({w}, ' ') AND length(replace({w}, ' ', '')) >= 3",
        "alternating_case": (
            f"{w} <> lower({w}) AND {w} <> upper({w}) AND NOT {title_case(w)} "
            f"AND length({w}) > 3 AND {case_changes(w)} > length({w}) / 3"
        ),
    }


def word_label(w: str) -> str:
    cases = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in word_rules(w).items())
    return f"CASE WHEN length({w}) < 3 THEN NULL {cases} END"


def threshold(n: str, rule: tuple[int, float, int]) -> str:
    low, share, high = rule
    return f"greatest({low}, least(round_even({n} * {share}::DOUBLE, 0), {high}))::BIGINT"


def audit(forms: str) -> str:
    """CTEs ``msgs`` (with whole label), ``audit`` (one row per word) and ``per_msg``."""
    return f"""
    forms AS ({forms}),
    msgs AS (
      SELECT msg_id, source, variant, text, {words('text')} AS ws, {whole_label('t')} AS whole
      FROM (SELECT *, {trim('text')} AS t FROM forms)
    ),
    cores AS (
      SELECT msg_id, variant, pos, word, {core('word')} AS w
      FROM (SELECT msg_id, variant, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos
            FROM msgs)
    ),
    vocabulary AS (
      SELECT w, {letters('w')} >= 3 AS checked,
             CASE WHEN {letters('w')} >= 3 THEN {word_label('w')} END AS enc
      FROM (SELECT DISTINCT w FROM cores)
    ),
    audit AS (SELECT msg_id, variant, pos, word, checked, enc FROM cores JOIN vocabulary USING (w)),
    islands AS (
      SELECT msg_id, variant, pos - row_number() OVER (PARTITION BY msg_id, variant ORDER BY pos) AS g
      FROM audit WHERE enc IS NOT NULL
    ),
    runs AS (
      SELECT msg_id, variant, max(n) AS run
      FROM (SELECT msg_id, variant, g, count(*) AS n FROM islands GROUP BY ALL) GROUP BY ALL
    ),
    type_counts AS (
      SELECT msg_id, variant, enc, count(*) AS n, min(pos) AS first
      FROM audit WHERE enc IS NOT NULL GROUP BY ALL
    ),
    tallies AS (
      SELECT msg_id, variant, count(*) FILTER (checked) AS checked,
             count(enc) AS encoded,
             coalesce(string_agg(CASE WHEN enc IS NOT NULL THEN pos::VARCHAR END, ',' ORDER BY pos), '')
               AS positions
      FROM audit GROUP BY ALL
    ),
    limits AS (
      SELECT msg_id, source, variant, text, whole, len(ws) AS n_words,
             {threshold('len(ws)', C.RUN_THRESHOLD)} AS run_limit,
             {threshold('len(ws)', C.SAME_TYPE_THRESHOLD)} AS type_limit
      FROM msgs
    ),
    typed AS (
      SELECT msg_id, variant,
             string_agg(enc || '=' || n, ',' ORDER BY first) AS counts,
             max(n) AS top,
             string_agg(CASE WHEN n >= type_limit THEN 'More than ' || (type_limit - 1) || ' ' || enc
               || ' encoded words (' || n || ' found). (Threshold: ' || type_limit || ')' END,
               ', ' ORDER BY first) AS type_reasons
      FROM type_counts JOIN limits USING (msg_id, variant) GROUP BY ALL
    ),
    per_msg AS (
      SELECT msg_id, source, variant, text, whole, n_words, run_limit, type_limit,
             coalesce(run, 0) AS run, coalesce(counts, '') AS counts,
             coalesce(checked, 0) AS checked, coalesce(encoded, 0) AS encoded,
             coalesce(positions, '') AS positions,
             coalesce(run, 0) >= run_limit AS run_flag,
             coalesce(top, 0) >= type_limit AS type_flag,
             concat_ws(', ',
               CASE WHEN coalesce(run, 0) >= run_limit THEN 'More than ' || (run_limit - 1)
                 || ' consecutive encoded words (' || run || ' found). (Threshold: ' || run_limit
                 || ')' END,
               type_reasons) AS reasons
      FROM limits LEFT JOIN runs USING (msg_id, variant) LEFT JOIN typed USING (msg_id, variant)
           LEFT JOIN tallies USING (msg_id, variant)
    )"""
