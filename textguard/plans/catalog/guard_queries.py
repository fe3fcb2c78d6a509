"""Queries over the whole guard: verdicts, blocks, replies, logs, streams."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators import classifier as CL
from textguard.operators import language as L
from textguard.operators import replies as RP
from textguard.operators import spans as SP
from textguard.operators import term_model as TM
from textguard.plans import guard as G
from textguard.plans.catalog import sqltext as Q
from textguard.plans.catalog.language_queries import (
    MEMORY_SQL,
    detect_sql,
    documents,
    memory,
)
from textguard.plans.catalog.pii_queries import NAMES_SQL, mask_sql, named_masks_sql, names
from textguard.plans.catalog.registry import register
from textguard.plans.catalog.training_queries import (
    HOSTILE_WORDS,
    TRAINED_SQL,
    hits_sql,
    model_scores_sql,
    trained,
)
from textguard.plans.catalog.variants import FORMS, forms
from textguard.sources.shared import shared_folder
from textguard.sources.tables import (
    DOCUMENT_SCHEMA,
    read_step_log,
    read_table,
    spread,
    stream_messages,
    turn_id,
    write_guarded,
)
from textguard.streaming.guard_stream import start_guard

_FORMS = ("plain", "leet_o")
GATE_WORDS = HOSTILE_WORDS + ["disgusting", "pathetic", "scum", "trash", "worthless"]


@register(
    "conversation_replies",
    f"""SELECT conv_id, turn, md5(CASE WHEN next_role = 'assistant' THEN next_text
                 ELSE '{RP.NO_REPLY}' END) AS digest
        FROM (SELECT conv_id, turn, role,
                     lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
                     lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role
              FROM conversations) WHERE role = 'user'""",
)
def conversation_replies(spark, folder):
    replies = RP.conversation_replies(read_table(spark, folder, "conversations"))
    return replies.select("conv_id", "turn", F.md5(F.col("reply").cast("binary")).alias("digest"))


def messages(spark, folder) -> DataFrame:
    """Turns of users and systems, documents plain and with one letter swapped, and a row
    without a text beside each system turn."""
    turns = read_table(spark, folder, "conversations").filter("role <> 'assistant'")
    chat = turns.select(
        turn_id().alias("msg_id"),
        "text",
        F.lit("chat").alias("source"),
        "role",
    )
    missing = chat.filter("role = 'system'").select(
        F.concat("msg_id", F.lit(":missing")).alias("msg_id"),
        F.lit(None).cast("string").alias("text"),
        "source",
    )
    docs = forms(spark, folder, *_FORMS).select(
        F.concat_ws(":", "variant", F.col("msg_id").cast("string")).alias("msg_id"),
        "text",
        "source",
    )
    return spread(chat.drop("role")).unionByName(missing).unionByName(docs)


MESSAGES_SQL = f"""
    SELECT conv_id || ':' || turn AS msg_id, text, 'chat' AS source
    FROM conversations WHERE role <> 'assistant'
    UNION ALL
    SELECT conv_id || ':' || turn || ':missing', NULL, 'chat'
    FROM conversations WHERE role = 'system'
    UNION ALL
    SELECT 'plain:' || doc_id, text, source FROM documents
    UNION ALL
    SELECT 'leet_o:' || doc_id, {FORMS['leet_o'][1]}, source FROM documents"""


def tables(spark, folder) -> G.GuardTables:
    docs = documents(spark, folder)
    turns = read_table(spark, folder, "conversations")
    answers = RP.conversation_replies(turns, missing=None).filter("reply IS NOT NULL")
    return G.GuardTables(
        memory=memory(docs),
        replies=answers.select(
            turn_id().alias("prompt_id"), "reply"
        ),
        language_lookup=L.profile_lookup(L.build_profiles(docs)),
    )


def guarded(spark, folder, **settings) -> DataFrame:
    return G.guard(
        messages(spark, folder),
        tables(spark, folder),
        CL.word_list_scorer(GATE_WORDS),
        **settings,
    )


def judged_at_gate(spark, folder) -> DataFrame:
    """Messages after the third step, with all verdicts but PASSED, which is still NULL."""
    opened = G.translate(
        G.check_obfuscation(messages(spark, folder)), tables(spark, folder)
    )
    return G.gate(opened, CL.word_list_scorer(GATE_WORDS))


_WORD_LIST_GATE = (
    f"gated AS (SELECT *, 1 - pow(0.5, {hits_sql('current_text', GATE_WORDS)}) AS score FROM current)"
)


def _masked_ctes(named: bool) -> str:
    """CTEs ``answered`` and ``masked``: both redactions, by patterns or by patterns and names."""
    opened = f"""SELECT msg_id, stored_lang, current_text, coalesce(answer, '{RP.NO_REPLY}') AS reply
      FROM gated LEFT JOIN answers USING (msg_id) WHERE score <= 0.82"""
    if not named:
        return f"""
    answered AS (SELECT *, {mask_sql('current_text')} AS prompt FROM ({opened})),
    masked AS (SELECT *, {mask_sql('reply')} AS safe_reply FROM answered)"""
    return f"""{NAMES_SQL},
    opened AS MATERIALIZED ({opened}),
    {named_masks_sql('(SELECT msg_id, current_text AS text FROM opened)', 'p_')},
    {named_masks_sql('(SELECT msg_id, reply AS text FROM opened)', 'r_')},
    answered AS (SELECT o.*, masked AS prompt FROM opened o JOIN p_masks USING (msg_id)),
    masked AS (SELECT a.*, m.masked AS safe_reply FROM answered a JOIN r_masks m USING (msg_id))"""


def guard_sql(source: str, gate: str = _WORD_LIST_GATE, named: bool = False) -> str:
    """CTE ``judged``: one row per message of ``source`` with all the guard adds; ``gate`` is the
    CTE that adds the score, ``named`` masks names as well."""
    return f"""
    input AS ({source}),
    {Q.audit("SELECT msg_id, source, '' AS variant, text FROM input WHERE text IS NOT NULL")},
    checked AS (
      SELECT msg_id, source, text, whole IS NOT NULL OR run_flag OR type_flag AS flagged,
             CASE WHEN whole IS NULL THEN reasons ELSE
               'Entire text appears to be ' || replace(whole, '_', ' ') || ' encoded' END AS why
      FROM per_msg
    ),
    unflagged AS (SELECT msg_id, text FROM checked WHERE NOT flagged),
    {detect_sql('unflagged')},
    {MEMORY_SQL},
    current AS (
      SELECT msg_id, lang, CASE WHEN hit THEN target_text ELSE text END AS current_text,
             CASE WHEN hit THEN lang END AS stored_lang
      FROM (SELECT *, target_text IS NOT NULL AND lang <> 'en' AS hit
            FROM unflagged LEFT JOIN spoken USING (msg_id)
            LEFT JOIN memory ON lang_pair = lang || '|en' AND src_md5 = md5(text))
    ),
    {gate},
    answers AS (
      SELECT conv_id || ':' || turn AS msg_id, next_text AS answer
      FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
                   lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role
            FROM conversations) WHERE role = 'user' AND next_role = 'assistant'
    ),
    {_masked_ctes(named)},
    finished AS (
      SELECT msg_id, prompt, reply, safe_reply, coalesce(target_text, safe_reply) AS final_text
      FROM masked LEFT JOIN memory
        ON lang_pair = 'en|' || stored_lang AND src_md5 = md5(safe_reply)
    ),
    judged AS (
      SELECT i.msg_id, i.source, i.text,
             CASE WHEN i.text IS NULL THEN 'ERROR' WHEN flagged THEN 'BLOCKED_OBFUSCATION'
                  WHEN score > 0.82 THEN 'BLOCKED_JAILBREAK' ELSE 'PASSED' END AS verdict,
             CASE WHEN flagged THEN why END AS why, lang, stored_lang, score, prompt, safe_reply,
             final_text
      FROM input i LEFT JOIN checked USING (msg_id) LEFT JOIN gated USING (msg_id)
           LEFT JOIN finished USING (msg_id)
    )"""


def _md5(name: str):
    return F.md5(F.col(name).cast("binary")).alias(name)


_ALL_STEPS_SQL = f"""WITH {guard_sql(MESSAGES_SQL)}
        SELECT msg_id, source, verdict, lang, stored_lang, score, md5(prompt) AS prompt,
               md5(safe_reply) AS safe_reply, md5(final_text) AS final_text FROM judged"""
_ALL_STEPS = ("msg_id", "source", "verdict", "lang", "stored_lang", "score")


@register("guard_messages", _ALL_STEPS_SQL)
def guard_messages(spark, folder):
    """All seven steps."""
    judged = guarded(spark, folder, log=False)
    return judged.select(*_ALL_STEPS, _md5("prompt"), _md5("safe_reply"), _md5("final_text"))


@register("guard_in_one_exchange", _ALL_STEPS_SQL)
def guard_in_one_exchange(spark, folder):
    """All seven steps with tables held to be beyond a broadcast."""
    large = dataclasses.replace(tables(spark, folder), large=True)
    judged = G.guard(messages(spark, folder), large, CL.word_list_scorer(GATE_WORDS), log=False)
    return judged.select(*_ALL_STEPS, _md5("prompt"), _md5("safe_reply"), _md5("final_text"))


@register(
    "blocked_by_obfuscation",
    f"""WITH {guard_sql(MESSAGES_SQL)}
        SELECT msg_id, '{G.OBFUSCATION_BLOCK}' || why AS message FROM judged
        WHERE verdict = 'BLOCKED_OBFUSCATION'""",
)
def blocked_by_obfuscation(spark, folder):
    checked = G.check_obfuscation(messages(spark, folder))
    return checked.filter(F.col("verdict") == G.BLOCKED_OBFUSCATION).select(
        "msg_id",
        F.concat(
            F.lit(G.OBFUSCATION_BLOCK), F.array_join("report.flag_reasons", ", ")
        ).alias("message"),
    )


@register(
    "blocked_by_classifier",
    f"""WITH {guard_sql(MESSAGES_SQL)}
        SELECT msg_id, printf('%.4f', score) AS score FROM judged
        WHERE verdict = 'BLOCKED_JAILBREAK'""",
)
def blocked_by_classifier(spark, folder):
    return judged_at_gate(spark, folder).filter(F.col("verdict") == G.BLOCKED_JAILBREAK).select(
        "msg_id", F.format_string("%.4f", "score").alias("score")
    )


@register(
    "verdicts_and_outputs",
    f"""WITH {guard_sql(MESSAGES_SQL)}
        SELECT msg_id, verdict, md5(CASE verdict
                 WHEN 'PASSED' THEN '🏁 Final Output: ''' || final_text || ''''
                 WHEN 'ERROR' THEN 'An error occurred:\nmessage has no text'
                 ELSE '{G.FLAGGED_OUTPUT}' END) AS final_output FROM judged""",
)
def verdicts_and_outputs(spark, folder):
    return guarded(spark, folder, log=False).select("msg_id", "verdict", _md5("final_output"))


@register(
    "verdict_summary",
    f"""WITH {guard_sql(MESSAGES_SQL)}
        SELECT source, verdict, count(*) AS n FROM judged GROUP BY ROLLUP (source, verdict)""",
)
def verdict_summary(spark, folder):
    """Verdicts are settled at the gate: replies and the way back are not looked up."""
    gated = judged_at_gate(spark, folder)
    return G.verdict_summary(gated.withColumn("verdict", F.coalesce("verdict", F.lit(G.PASSED))))


@register(
    "unusable_messages",
    f"""SELECT conv_id || ':' || turn || ':missing' AS msg_id, 'ERROR' AS verdict, 'message has no text' AS error
       FROM conversations WHERE role = 'system'""",
)
def unusable_messages(spark, folder):
    """Rows the guard could not judge, kept with the reason."""
    return guarded(spark, folder, log=False).filter(F.col("verdict") == G.ERROR).select(
        "msg_id", "verdict", "error"
    )


@register(
    "step_log_statuses",
    f"""WITH {guard_sql(MESSAGES_SQL)},
        steps AS (
          SELECT 'obfuscation' AS step, CASE verdict WHEN 'BLOCKED_OBFUSCATION' THEN 'BLOCKED'
                   ELSE 'PASSED' END AS status FROM judged WHERE verdict <> 'ERROR'
          UNION ALL
          SELECT 'translation', CASE WHEN stored_lang IS NULL THEN 'PASSED' ELSE 'CHANGED' END
          FROM judged WHERE verdict IN ('PASSED', 'BLOCKED_JAILBREAK')
          UNION ALL
          SELECT 'jailbreak', CASE verdict WHEN 'PASSED' THEN 'PASSED' ELSE 'BLOCKED' END
          FROM judged WHERE verdict IN ('PASSED', 'BLOCKED_JAILBREAK')
          UNION ALL
          SELECT 'pii1', CASE WHEN prompt <> current_text THEN 'CHANGED' ELSE 'PASSED' END
          FROM judged JOIN current USING (msg_id) WHERE verdict = 'PASSED'
          UNION ALL
          SELECT 'llm', 'PASSED' FROM judged WHERE verdict = 'PASSED'
          UNION ALL
          SELECT 'pii2', CASE WHEN safe_reply <> reply THEN 'CHANGED' ELSE 'PASSED' END FROM masked
          UNION ALL
          SELECT 'translate_back', CASE WHEN stored_lang IS NULL THEN 'PASSED' ELSE 'CHANGED' END
          FROM judged WHERE verdict = 'PASSED'
          UNION ALL
          SELECT 'final_output', CASE WHEN verdict LIKE 'BLOCKED%' THEN 'BLOCKED' ELSE verdict END
          FROM judged
        )
        SELECT step, status, count(*) AS n FROM steps GROUP BY ALL""",
)
def step_log_statuses(spark, folder):
    events = guarded(spark, folder).select(F.inline("step_log"))
    return events.groupBy("step", "status").agg(F.count("*").alias("n"))


def _filled(template: str, *values: str) -> str:
    """SQL for a template of the plan with values in its places."""
    parts = [part.replace("'", "''") for part in template.split("{}")]
    return "".join(f"'{part}' || {value} || " for part, value in zip(parts, values, strict=False)) + f"'{parts[-1]}'"


_STEP_TEXTS_SQL = f"""
    told AS (
      SELECT j.*, g.current_text, reply FROM judged j LEFT JOIN gated g USING (msg_id) LEFT JOIN answered USING (msg_id)
    ),
    steps AS (
      SELECT msg_id, 'obfuscation' AS step, CASE verdict WHEN 'BLOCKED_OBFUSCATION' THEN '{G.OBFUSCATION_BLOCK}' || why
               ELSE '{G.OBFUSCATION_PASS}' END AS message FROM told WHERE verdict <> 'ERROR'
      UNION ALL
      SELECT msg_id, 'translation', CASE WHEN stored_lang IS NULL THEN '{G.NOT_TRANSLATED}'
               ELSE {_filled(G.TRANSLATED, "stored_lang")} END FROM told WHERE verdict IN ('PASSED', 'BLOCKED_JAILBREAK')
      UNION ALL
      SELECT msg_id, 'jailbreak', CASE verdict WHEN 'PASSED' THEN {_filled(G.JAILBREAK_PASS, "printf('%.4f', score)")}
               ELSE {_filled(G.JAILBREAK_BLOCK, "printf('%.4f', score)")} END
      FROM told WHERE verdict IN ('PASSED', 'BLOCKED_JAILBREAK')
      UNION ALL
      SELECT msg_id, 'pii1', CASE WHEN prompt <> current_text THEN {_filled(G.PII_FOUND, "prompt")}
               ELSE '{G.PII_NONE}' END FROM told WHERE verdict = 'PASSED'
      UNION ALL
      SELECT msg_id, 'llm', {_filled(G.REPLY, "reply")} FROM told WHERE verdict = 'PASSED'
      UNION ALL
      SELECT msg_id, 'pii2', CASE WHEN safe_reply <> reply THEN {_filled(G.REPLY_PII_FOUND, "safe_reply")}
               ELSE '{G.REPLY_PII_NONE}' END FROM told WHERE verdict = 'PASSED'
      UNION ALL
      SELECT msg_id, 'translate_back', CASE WHEN stored_lang IS NULL THEN '{G.NO_BACK}'
               ELSE {_filled(G.BACK, "stored_lang", "final_text")} END FROM told WHERE verdict = 'PASSED'
      UNION ALL
      SELECT msg_id, 'final_output', CASE verdict WHEN 'PASSED' THEN {_filled(G.FINAL_OUTPUT, "final_text")}
               WHEN 'ERROR' THEN {_filled(G.ERROR_OUTPUT, "'message has no text'")} ELSE '{G.FLAGGED_OUTPUT}' END FROM told
    )"""


@register(
    "step_log_messages",
    f"""WITH {guard_sql(MESSAGES_SQL)}, {_STEP_TEXTS_SQL}
        SELECT msg_id, step, md5(message) AS message FROM steps""",
)
def step_log_messages(spark, folder):
    """What a user reads at each step, written with the verdicts and read back.

    All texts are kept for the log, so that they are shuffled once, not at each look-up.
    """
    home = shared_folder(spark, "guarded-batch")
    large = dataclasses.replace(tables(spark, folder), large=True)
    write_guarded(G.guard(messages(spark, folder), large, CL.word_list_scorer(GATE_WORDS)), home)
    return read_step_log(spark, home).select("msg_id", "step", _md5("message"))


@register(
    "guard_with_fitted_classifier",
    f"""WITH {TRAINED_SQL},
        {guard_sql(MESSAGES_SQL, f"""gated AS (
          SELECT c.*, p1 AS score FROM current c JOIN (
            {model_scores_sql("(SELECT msg_id, current_text AS text FROM current)", "msg_id")}) USING (msg_id))""")}
        SELECT msg_id, source, verdict, round(score, 6) AS score FROM judged""",
)
def guard_with_fitted_classifier(spark, folder):
    """The guard with the trained classifier at the gate."""
    _, done = trained(spark, folder)
    judged = G.guard(
        messages(spark, folder), tables(spark, folder), TM.term_scorer(done.model), log=False
    )
    return judged.select("msg_id", "source", "verdict", F.round("score", 6).alias("score"))


@register(
    "guard_with_names",
    f"""WITH {guard_sql(MESSAGES_SQL, named=True)}
        SELECT msg_id, verdict, md5(prompt) AS prompt, md5(safe_reply) AS safe_reply,
               md5(final_text) AS final_text FROM judged""",
)
def guard_with_names(spark, folder):
    """The guard with a list of names masked in prompts and replies."""
    judged = guarded(spark, folder, log=False, masking=SP.Masking(names(spark, folder)))
    return judged.select("msg_id", "verdict", _md5("prompt"), _md5("safe_reply"), _md5("final_text"))


#: The tagger of the query below cannot read texts with this letter.
_UNREADABLE = "ß"


def _poor_tagger():
    unreadable = _UNREADABLE

    def tag(texts):
        if texts.str.contains(unreadable, regex=False).any():
            raise ValueError("cannot read this")
        return texts.map(lambda text: None)

    return tag


@register(
    "guard_with_failing_tagger",
    f"""WITH {guard_sql(MESSAGES_SQL)}
        SELECT j.msg_id, CASE WHEN failed THEN 'ERROR' ELSE verdict END AS verdict,
               CASE WHEN failed THEN 'redaction failed: ValueError: cannot read this'
                    WHEN verdict = 'ERROR' THEN 'message has no text' END AS error
        FROM (SELECT msg_id, verdict, verdict = 'PASSED' AND (contains(current_text, '{_UNREADABLE}')
                       OR contains(reply, '{_UNREADABLE}')) AS failed
              FROM judged LEFT JOIN (SELECT msg_id, current_text, reply FROM answered) USING (msg_id)) j""",
)
def guard_with_failing_tagger(spark, folder):
    """A tagger that fails on some texts costs those messages, not the job."""
    judged = guarded(spark, folder, log=False, masking=SP.Masking(tagger=_poor_tagger()))
    return judged.select("msg_id", "verdict", "error")


_DOCUMENTS_SQL = "SELECT doc_id::VARCHAR AS msg_id, text, source FROM documents"


@register(
    "guard_stream",
    f"""WITH {guard_sql(_DOCUMENTS_SQL)}
        SELECT msg_id, verdict, stored_lang, score, md5(final_text) AS final_text FROM judged""",
)
def guard_stream(spark, folder):
    """The documents table read as a stream, guarded, written by verdict and read back.

    The path is a pattern, as a stream takes a folder or a pattern but not one file.
    """
    arriving = stream_messages(
        spark, f"{folder}/documents.parquet*", DOCUMENT_SCHEMA, "doc_id", "source"
    ).withColumn("msg_id", F.col("msg_id").cast("string"))
    home = shared_folder(spark, "guard-stream")
    running = start_guard(
        arriving,
        tables(spark, folder),
        CL.word_list_scorer(GATE_WORDS),
        f"{home}/verdicts",
        f"{home}/checkpoint",
        available_now=True,
        log=False,
    )
    running.awaitTermination()
    written = spark.read.parquet(f"{home}/verdicts")
    return written.select("msg_id", "verdict", "stored_lang", "score", _md5("final_text"))
