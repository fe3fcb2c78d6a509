"""Queries over personal-data spans and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.functions import redact as R
from textguard.operators import pii as PI
from textguard.operators import spans as SP
from textguard.plans.catalog.language_queries import documents
from textguard.plans.catalog.registry import SQL, register
from textguard.plans.catalog.sqltext import WS

# --- fixed values: what the queries' SQL looks for, written out on its own ----
PATTERNS_SQL = {
    "EMAIL": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "IPV4": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "PHONE": r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "SECRET": r"[0-9a-fA-F]{32,}",
    "DIGITS": r"[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{9,}",
}
MASK_SQL = "[redacted]"
# --------------------------------------------------------------------------
ANY = "|".join(f"(?:{p})" for p in PATTERNS_SQL.values())
_BLANK = f"^{WS}*$"
_TYPES = " ".join(
    f"WHEN regexp_matches(value, '^(?:{p})$') THEN '{name}'" for name, p in PATTERNS_SQL.items()
)
LABEL_SQL = f"CASE {_TYPES} END"


def tidy_sql(text: str) -> str:
    return f"replace(replace(replace({text}, ' ]', ']'), '[ ', '['), '  ', ' ')"


def mask_sql(text: str) -> str:
    """Whole runs of matches, whitespace between them included, replaced in one go."""
    return tidy_sql(
        f"regexp_replace({text}, '(?:{ANY})(?:{WS}*(?:{ANY}))*', '{MASK_SQL}', 'g')"
    )


PIECES_SQL = f"""
    pieces AS (
      SELECT doc_id AS msg_id, text, generate_subscripts(m, 1) AS i, unnest(m) AS value,
             unnest(regexp_split_to_array(text, '{ANY}')[:-2]) AS gap,
             regexp_split_to_array(text, '{ANY}')[-1] AS tail
      FROM (SELECT doc_id, text, regexp_extract_all(text, '{ANY}') AS m FROM documents)
      WHERE len(m) > 0
    ),
    spans AS (
      SELECT msg_id, value, {LABEL_SQL} AS label,
             (sum(length(gap) + length(value)) OVER (PARTITION BY msg_id ORDER BY i)
               - length(value))::BIGINT AS start,
             (sum(length(gap) + length(value)) OVER (PARTITION BY msg_id ORDER BY i))::BIGINT
               AS "end"
      FROM pieces
    )"""


@register(
    "pii_spans", f'WITH {PIECES_SQL} SELECT msg_id, start, "end", label, value FROM spans'
)
def pii_spans(spark, folder):
    return PI.pii_spans(documents(spark, folder))


_TOUCHING_SQL = f"""{PIECES_SQL},
    touching AS (
      SELECT msg_id, start, "end", label FROM spans
      UNION ALL SELECT msg_id, "end", "end" + 12, 'NEXT' FROM spans
    ),
    opened AS (
      SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY msg_id ORDER BY start, "end"
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
      FROM touching
    ),
    islands AS (
      SELECT *, sum(opens) OVER (PARTITION BY msg_id ORDER BY start, "end") AS island FROM opened
    )"""


@register(
    "merge_touching_spans",
    f"""WITH {_TOUCHING_SQL}
        SELECT msg_id, min(start) AS start, max("end") AS "end", arg_min(label, start) AS label,
               count(*) AS n
        FROM islands GROUP BY msg_id, island""",
)
def merge_touching_spans(spark, folder):
    """Every match followed by a span of another type that touches it."""
    spans = PI.pii_spans(documents(spark, folder)).select("msg_id", "start", "end", "label")
    after = spans.select(
        "msg_id",
        F.col("end").alias("start"),
        (F.col("end") + 12).alias("end"),
        F.lit("NEXT").alias("label"),
    )
    return PI.merge_touching(spans.unionByName(after))


@register(
    "redact_together",
    f"""SELECT doc_id AS msg_id, md5(r) AS digest, r <> text AS changed
        FROM (SELECT doc_id, text, {mask_sql('text')} AS r FROM documents)""",
)
def redact_together(spark, folder):
    redacted = PI.redact(documents(spark, folder))
    return redacted.select("msg_id", F.md5(F.col("redacted").cast("binary")).alias("digest"), "changed")


@register(
    "redact_by_type",
    f"""WITH {PIECES_SQL},
        marked AS (
          SELECT msg_id, i, gap, tail, {LABEL_SQL} AS label, regexp_matches(gap, '{_BLANK}') AND i > 1
                   AS blank FROM pieces
        ),
        built AS (
          SELECT msg_id, i, tail, CASE WHEN NOT blank THEN gap || '[' || label || ']'
                   WHEN label = lag(label) OVER (PARTITION BY msg_id ORDER BY i) THEN ''
                   ELSE '[' || label || ']' END AS piece FROM marked
        ),
        joined AS (SELECT msg_id, string_agg(piece, '' ORDER BY i) || any_value(tail) AS r
                   FROM built GROUP BY msg_id)
        SELECT doc_id AS msg_id, md5({tidy_sql('coalesce(r, text)')}) AS digest
        FROM documents LEFT JOIN joined ON msg_id = doc_id""",
)
def redact_by_type(spark, folder):
    redacted = PI.redact(documents(spark, folder), aggregate=False)
    return redacted.select("msg_id", F.md5(F.col("redacted").cast("binary")).alias("digest"))


#: Pieces longer than any address in the tables, appended to each text.
_LONG_SQL = """text || ' ' || repeat('m', 100) || '@host.example ' || 'a@' || repeat('d', 70)
    || '.example ' || 'a@' || repeat('l.', 26) || 'example_b@c.example a@müller.example jürgen@x.example'"""


@register(
    "redact_long_addresses",
    f"""SELECT doc_id AS msg_id, md5({mask_sql('long')}) AS digest
        FROM (SELECT doc_id, {_LONG_SQL} AS long FROM documents)""",
)
def redact_long_addresses(spark, folder):
    """Long mailboxes, long and many labels, an address right after another, letters beyond ASCII."""
    long = F.concat(
        F.col("text"), F.lit(" "), F.repeat(F.lit("m"), F.lit(100)), F.lit("@host.example a@"),
        F.repeat(F.lit("d"), F.lit(70)), F.lit(".example a@"), F.repeat(F.lit("l."), F.lit(26)),
        F.lit("example_b@c.example a@müller.example jürgen@x.example"),
    )
    redacted = PI.redact(documents(spark, folder).withColumn("text", long))
    return redacted.select("msg_id", F.md5(F.col("redacted").cast("binary")).alias("digest"))


@register(
    "tidy_spaces",
    f"""SELECT doc_id AS msg_id, md5({tidy_sql("concat('[ ', replace(text, ' of ', '  of ] '), ' ]')")})
               AS digest FROM documents""",
)
def tidy_spaces(spark, folder):
    loose = F.concat(
        F.lit("[ "), F.replace(F.col("text"), F.lit(" of "), F.lit("  of ] ")), F.lit(" ]")
    )
    docs = documents(spark, folder)
    return docs.select("msg_id", F.md5(R.tidy(loose).cast("binary")).alias("digest"))


@register(
    "redaction_changed",
    f"""SELECT source, r <> text AS changed, count(*) AS n
        FROM (SELECT source, text, {mask_sql('text')} AS r FROM documents) GROUP BY ALL""",
)
def redaction_changed(spark, folder):
    redacted = PI.redact(documents(spark, folder))
    return redacted.groupBy("source", "changed").agg(F.count("*").alias("n"))


@register(
    "pii_counts_by_type",
    f"""SELECT {LABEL_SQL} AS label, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all(text, '{ANY}')) AS value FROM documents) GROUP BY ALL""",
)
def pii_counts_by_type(spark, folder):
    return PI.count_by_type(documents(spark, folder))


# --- names, and spans of several finders ----------------------------------
WORD_SQL = r"[\p{L}\p{M}\p{N}]+"
_BETWEEN_SQL = f"^(?:{WS}+|{WS}*[-''’.]{WS}*)$"
#: The first two words of every document stand in for a list of names.
NAMES_SQL = f"""
    names AS (
      SELECT DISTINCT lower(w[1]) || ' ' || lower(w[2]) AS name
      FROM (SELECT regexp_extract_all(text, '{WORD_SQL}') AS w FROM documents) WHERE len(w) > 1
    )"""


def names(spark, folder):
    # the first two words are read, not all of a text's
    word, between = WORD_SQL + "+", f"[^{WORD_SQL[1:-2]}]"
    first = f"^{between}*+({word}){between}++({word})"
    two = F.concat_ws(" ", *[F.regexp_extract("text", first, n) for n in (1, 2)])
    return documents(spark, folder).where(F.col("text").rlike(first)).select(two.alias("name")).distinct()


def named_tokens_sql(source: str, prefix: str, token: str) -> str:
    """CTE ``{prefix}tokens`` for ``source(msg_id, text)``: matches of ``token``, where they stand, and
    whether a name of two words starts with each; needs ``names``."""
    return f"""
    {prefix}cut AS (
      SELECT msg_id, generate_subscripts(t, 1) AS i, unnest(t) AS word, unnest(gaps[:len(t)]) AS gap, gaps[-1] AS tail
      FROM (SELECT msg_id, regexp_extract_all(text, '{token}') AS t, regexp_split_to_array(text, '{token}') AS gaps
            FROM {source}) WHERE len(t) > 0
    ),
    {prefix}placed AS (
      SELECT *, sum(length(gap) + length(word)) OVER w AS stop, lead(word) OVER w AS next_word, lead(gap) OVER w AS next_gap
      FROM {prefix}cut WINDOW w AS (PARTITION BY msg_id ORDER BY i)
    ),
    {prefix}tokens AS (
      SELECT p.*, name IS NOT NULL AND regexp_matches(next_gap, '{_BETWEEN_SQL}') AS opens
      FROM {prefix}placed p LEFT JOIN names ON name = lower(word) || ' ' || lower(next_word)
    )"""


def named_masks_sql(source: str, prefix: str) -> str:
    """CTE ``{prefix}masks(msg_id, masked)``: patterns and names under one mark where they are neighbours."""
    return f"""{named_tokens_sql(source, prefix, f"(?:{ANY})|{WORD_SQL}")},
    {prefix}covered AS (
      SELECT *, regexp_matches(word, '^(?:{ANY})$') OR opens OR coalesce(lag(opens) OVER w, false) AS hit,
             coalesce(lag(opens) OVER w, false) AS inside
      FROM {prefix}tokens WINDOW w AS (PARTITION BY msg_id ORDER BY i)
    ),
    {prefix}pieces AS (
      SELECT msg_id, i, tail, CASE WHEN NOT hit THEN gap || word
               WHEN lag(hit) OVER w AND (inside OR regexp_matches(gap, '{_BLANK}')) THEN ''
               ELSE gap || '{MASK_SQL}' END AS piece
      FROM {prefix}covered WINDOW w AS (PARTITION BY msg_id ORDER BY i)
    ),
    {prefix}masks AS (
      SELECT msg_id, {tidy_sql("coalesce(joined, text)")} AS masked
      FROM {source} LEFT JOIN (SELECT msg_id, string_agg(piece, '' ORDER BY i) || any_value(tail) AS joined
                               FROM {prefix}pieces GROUP BY msg_id) USING (msg_id)
    )"""


_MESSAGES_SQL = "(SELECT doc_id AS msg_id, text FROM documents)"


@register(
    "name_spans",
    f"""WITH {NAMES_SQL}, {named_tokens_sql(_MESSAGES_SQL, 'n_', WORD_SQL)}
        SELECT msg_id, (stop - length(word))::BIGINT AS start,
               (stop + length(next_gap) + length(next_word))::BIGINT AS "end" FROM n_tokens WHERE opens""",
)
def name_spans(spark, folder):
    found = SP.find_names(documents(spark, folder), names(spark, folder))
    return found.select("msg_id", F.col("start").cast("bigint"), F.col("end").cast("bigint"))


@register(
    "redact_names",
    f"""WITH {NAMES_SQL}, {named_masks_sql(_MESSAGES_SQL, 'n_')}
        SELECT msg_id, md5(masked) AS digest FROM n_masks""",
)
def redact_names(spark, folder):
    """Patterns and names under one rule."""
    masking = SP.Masking(names(spark, folder))
    done = masking.apply(documents(spark, folder), "text", "redacted", "failed")
    return done.select("msg_id", F.md5(F.col("redacted").cast("binary")).alias("digest"))


@register("mask_spans", SQL["redact_together"].replace(", r <> text AS changed", ""))
def mask_spans(spark, folder):
    """The patterns alone by the fold over spans: the same masks as the expression's."""
    done = SP.mask_united(documents(spark, folder), "text", "redacted")
    return done.select("msg_id", F.md5(F.col("redacted").cast("binary")).alias("digest"))
