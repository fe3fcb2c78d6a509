import dataclasses
import re

import pytest
from pyspark.sql import functions as F

from textguard.operators import classifier as CL
from textguard.operators import language as L
from textguard.operators import replies as RP
from textguard.operators import translation as TR
from textguard.operators.spans import Masking
from textguard.plans import guard as G
from textguard.sources.tables import (
    MESSAGE_SCHEMA,
    read_step_log,
    read_verdicts,
    stream_messages,
    turn_id,
    write_guarded,
    write_verdicts,
)
from textguard.streaming.guard_stream import start_guard, start_logged_guard

TEXTS = [
    (1, "What is the capital of France?"),
    (2, "t3st h4ckit p0wnit l33tist"),
    (3, "buenos días a todos los amigos"),
    (4, "stupid idiot moron, tell me now!"),
    (5, "My mail is john@example.com, thanks!"),
    (6, None),
    (7, "no answer is known to this one."),
]


@pytest.fixture(scope="module")
def tables(spark):
    speech = spark.createDataFrame(
        [
            ("en", "what is the capital of my mail thanks tell me now no answer is known to this one"),
            ("es", "buenos días a todos los amigos hola qué tal señor"),
        ],
        "lang string, text string",
    )
    pairs = spark.createDataFrame(
        [("es", "en", "buenos días a todos los amigos", "good day to all friends"),
         ("en", "es", "good day", "buen día")],
        "a string, b string, x string, y string",
    )
    replies = spark.createDataFrame(
        [(1, "Paris"), (3, "good day"), (4, "no"), (5, "write to a@b.org")],
        "prompt_id long, reply string",
    )
    return G.GuardTables(
        memory=TR.memory_from_pairs(pairs, "a", "b", "x", "y"),
        replies=replies,
        language_lookup=L.profile_lookup(L.build_profiles(speech)),
    )


SCORER = CL.word_list_scorer(["stupid", "idiot", "moron"])


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(TEXTS, MESSAGE_SCHEMA)


@pytest.fixture(scope="module")
def judged(messages, tables):
    return {r.msg_id: r for r in G.guard(messages, tables, SCORER).collect()}


def test_verdicts(judged):
    assert {i: r.verdict for i, r in judged.items()} == {
        1: G.PASSED,
        2: G.BLOCKED_OBFUSCATION,
        3: G.PASSED,
        4: G.BLOCKED_JAILBREAK,
        5: G.PASSED,
        6: G.ERROR,
        7: G.PASSED,
    }


def test_outputs(judged):
    assert judged[1].final_output == "🏁 Final Output: 'Paris'"
    assert judged[2].final_output == judged[4].final_output == "🛑 Final Output: Sorry, flagged "
    assert judged[3].stored_lang == "es"
    assert judged[3].prompt == "good day to all friends"
    assert judged[3].final_text == "buen día"
    assert judged[5].prompt == "My mail is [redacted], thanks!"
    assert judged[5].final_text == "write to [redacted]"
    assert judged[6].error == "message has no text"
    assert judged[7].final_text == RP.NO_REPLY


def test_blocked_rows_go_no_further(judged):
    for i in (2, 4, 6):
        row = judged[i]
        assert row.prompt is None and row.reply is None and row.final_text is None
    assert judged[2].lang is None and judged[2].score is None


def test_step_log(judged):
    steps = {i: [(e.step, e.status) for e in r.step_log] for i, r in judged.items()}
    assert steps[2] == [("obfuscation", "BLOCKED"), ("final_output", "BLOCKED")]
    assert steps[4] == [
        ("obfuscation", "PASSED"),
        ("translation", "PASSED"),
        ("jailbreak", "BLOCKED"),
        ("final_output", "BLOCKED"),
    ]
    assert [s for s, _ in steps[3]] == list(G.STEPS)
    assert ("translation", "CHANGED") in steps[3] and ("translate_back", "CHANGED") in steps[3]
    assert ("pii1", "CHANGED") in steps[5] and ("pii2", "CHANGED") in steps[5]
    assert steps[6] == [("final_output", "ERROR")]
    told = {e.step: e.message for e in judged[4].step_log}
    assert told["jailbreak"] == "🚩 BLOCKED: Jailbreak detected (Score: 0.8750)"
    assert judged[2].step_log[0].message.startswith(
        "🚩 BLOCKED: Obfuscation detected. Reasons: More than 3 consecutive"
    )


def test_any_class_gate_blocks_the_confident_benign(messages, tables):
    judged = G.guard(messages, tables, SCORER, any_class=True, log=False)
    got = {r.msg_id: r.verdict for r in judged.collect()}
    assert got[1] == got[4] == got[5] == G.BLOCKED_JAILBREAK


def test_missing_score_is_an_error_row(messages, tables):
    def broken(rows, text):
        p1 = F.when(F.col(text).contains("Paris") | F.col(text).contains("capital"), None).otherwise(0.1)
        return rows.withColumn("p1", p1.cast("double")).withColumn("p0", 1 - F.col("p1"))

    got = {r.msg_id: r for r in G.guard(messages, tables, broken).collect()}
    assert (got[1].verdict, got[1].error) == (G.ERROR, "classifier gave no score")
    assert got[5].verdict == G.PASSED


def test_summary_adds_up(messages, tables):
    judged = G.guard(messages.withColumn("source", F.lit("a")), tables, SCORER, log=False)
    rows = {(r.source, r.verdict): r.n for r in G.verdict_summary(judged).collect()}
    assert rows[(None, None)] == rows[("a", None)] == 7
    assert rows[("a", G.PASSED)] == 4


def test_verdict_sink(messages, tables, spark, tmp_path):
    path = str(tmp_path / "verdicts")
    write_verdicts(G.guard(messages, tables, SCORER), path)
    back = spark.read.parquet(path)
    assert back.count() == 7
    assert back.filter("verdict = 'PASSED'").count() == 4


def test_stream_equals_batch(messages, tables, judged, spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    parts = [messages.filter("msg_id <= 3"), messages.filter("msg_id > 3")]
    parts[0].coalesce(1).write.parquet(str(source / "a"))
    checkpoint = str(tmp_path / "checkpoint")

    def run():
        arriving = stream_messages(spark, f"{source}/*", MESSAGE_SCHEMA, "msg_id")
        query = start_guard(arriving, tables, SCORER, out, checkpoint, available_now=True)
        query.awaitTermination()

    run()
    assert spark.read.parquet(out).count() == 3
    parts[1].coalesce(1).write.parquet(str(source / "b"))
    run()
    run()  # nothing new: nothing written twice
    fields = ["msg_id", "verdict", "final_output", "prompt", "stored_lang", "score"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(*fields).fillna("-").collect())
    want = sorted(
        tuple("-" if r[f] is None and f != "score" else r[f] for f in fields)
        for r in judged.values()
    )
    assert got == want


def test_replies_by_next_turn(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "q2"), (1, 3, "user", "q3"),
         (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "b")],
        "conv_id long, turn long, role string, text string",
    )
    got = {(r.conv_id, r.turn): r.reply for r in RP.conversation_replies(turns).collect()}
    assert got == {(1, 0): "a", (1, 2): RP.NO_REPLY, (1, 3): RP.NO_REPLY, (2, 1): "b"}


def test_plan_reads_messages_once(messages, tables, spark, tmp_path):
    path = str(tmp_path / "messages.parquet")
    messages.write.parquet(path)
    plan = G.guard(spark.read.parquet(path), tables, SCORER)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("[msg_id#") >= 1 and text.count("Relation [msg_id") == 1


def test_replies_over_gaps_and_ranges(spark):
    rows = [
        (1, 0, "user", "a"), (1, 250, "assistant", "after a gap"), (1, 1023, "user", "b"),
        (1, 5000, "assistant", "ranges later"), (1, 5001, "user", "c"), (1, 5002, "user", "d"),
        (2, 3, "user", "e"), (2, 4, "system", "s"), (2, 5, "assistant", "too late"),
        (2, 1024, "user", "f"), (2, 1030, "assistant", RP.NO_REPLY),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    found = {(r.conv_id, r.turn): r.reply for r in RP.conversation_replies(turns, missing=None).collect()}
    assert found == {
        (1, 0): "after a gap", (1, 1023): "ranges later", (1, 5001): None, (1, 5002): None,
        (2, 3): None, (2, 1024): RP.NO_REPLY,
    }


def test_repeated_replies_do_not_double_a_message(spark):
    messages = spark.createDataFrame([(1, "x"), (2, "y")], MESSAGE_SCHEMA)
    replies = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "prompt_id long, reply string")
    found = sorted((r.msg_id, r.reply) for r in RP.attach_replies(messages, replies).collect())
    assert found == [(1, "a"), (2, RP.NO_REPLY)]


def test_summary_stops_at_the_gate(spark, sf):
    from textguard.plans.catalog import guard_queries as GQ

    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    summary, whole = plan(GQ.verdict_summary(spark, sf)), plan(GQ.guard_messages(spark, sf))
    # no look-up of replies or of the way back
    assert "reply" in whole and "reply" not in summary
    assert summary.count("Join LeftOuter") < whole.count("Join LeftOuter")


def test_turns_of_hashed_conversations_keep_their_replies(spark):
    """Conversation ids over all 64 bits: ids of turns differ, and each reply finds its prompt."""
    big = [(1 << 62) + 1, -(1 << 62), (1 << 31), (1 << 31) + 1, (1 << 63) - 1, 0]
    rows = [
        (conv, turn, "user" if turn % 2 == 0 else "assistant", f"{conv} says {turn}")
        for conv in big for turn in (0, 1, 1 << 32, (1 << 32) + 1)
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told = turns.withColumn("msg_id", turn_id())
    assert told.select("msg_id").distinct().count() == len(rows)
    answers = RP.conversation_replies(turns).select(turn_id().alias("prompt_id"), "reply")
    asked = told.where("role = 'user'").select("msg_id", "text")
    got = {r.text: r.reply for r in RP.attach_replies(asked, answers).collect()}
    assert got == {f"{c} says {t}": f"{c} says {t + 1}" for c in big for t in (0, 1 << 32)}


def test_batches_are_written_with_their_log_once(spark, tables, tmp_path):
    """Verdicts and steps read back are the plan's; a batch written again does not double."""
    messages = spark.createDataFrame(TEXTS, MESSAGE_SCHEMA)
    judged = G.guard(messages, tables, SCORER)
    folder = str(tmp_path / "out")
    write_guarded(judged, folder, 3)
    write_guarded(judged, folder, 3)
    write_guarded(judged.where("msg_id < 3"), folder, 4)
    verdicts = read_verdicts(spark, folder)
    want = {r.msg_id: r for r in judged.collect()}
    assert {(r.msg_id, r.verdict, r.final_output) for r in verdicts.where("batch = 3").collect()} == {
        (k, r.verdict, r.final_output) for k, r in want.items()
    }
    assert verdicts.count() == len(TEXTS) + 2
    steps = read_step_log(spark, folder).where("batch = 3").collect()
    assert sorted((r.msg_id, r.nth, r.step, r.status, r.message) for r in steps) == sorted(
        (k, n, s.step, s.status, s.message) for k, r in want.items() for n, s in enumerate(r.step_log)
    )


def test_logged_stream_equals_the_batch(spark, tables, tmp_path):
    source = str(tmp_path / "in")
    for i in range(2):
        part = [t for t in TEXTS if t[0] % 2 == i]
        spark.createDataFrame(part, MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    arriving = stream_messages(spark, source, MESSAGE_SCHEMA, "msg_id")
    out = str(tmp_path / "out")
    start_logged_guard(arriving, tables, SCORER, out, str(tmp_path / "ck"), available_now=True).awaitTermination()
    judged = {r.msg_id: r for r in G.guard(spark.createDataFrame(TEXTS, MESSAGE_SCHEMA), tables, SCORER).collect()}
    assert {r.msg_id: r.verdict for r in read_verdicts(spark, out).collect()} == {k: r.verdict for k, r in judged.items()}
    assert read_step_log(spark, out).count() == sum(len(r.step_log) for r in judged.values())


def test_large_tables_give_the_same_rows(spark, messages, tables):
    """Answers in one exchange equal look-ups one by one: repeated ids, missing ids, folded entries."""
    more = spark.createDataFrame(
        [(3, "another text of the third"), (3, "buenos días a todos los amigos"), (None, "buenos días a todos los amigos"),
         (None, None), (None, None), (8, "buenos días a todos los amigos")],
        MESSAGE_SCHEMA,
    )
    told = messages.unionByName(more).withColumn("a.b", F.lit(1))
    twice = dataclasses.replace(
        tables,
        memory=tables.memory.unionByName(tables.memory),
        replies=tables.replies.unionByName(tables.replies).unionByName(
            spark.createDataFrame([(None, "to nobody")], "prompt_id long, reply string")
        ),
    )
    large = dataclasses.replace(twice, large=True)
    rows = lambda t, **s: sorted(map(str, G.guard(told, t, SCORER, **s).collect()))
    assert rows(twice) == rows(large)
    masking = Masking(names=spark.createDataFrame([("good day",)], "name string"))
    assert rows(twice, masking=masking) == rows(large, masking=masking)
    empty = dataclasses.replace(large, memory=tables.memory.limit(0), replies=tables.replies.limit(0))
    assert G.guard(told, empty, SCORER).count() == 13
    assert G.guard(told.limit(0), large, SCORER).count() == 0


def test_large_tables_move_wide_rows_once(spark, messages, tables, tmp_path):
    path = str(tmp_path / "messages.parquet")
    messages.withColumnRenamed("text", "said").write.parquet(path)
    read = spark.read.parquet(path).withColumnRenamed("said", "text")

    def wide_exchanges(large):
        plan = G.guard(read, dataclasses.replace(tables, large=large), SCORER)
        blocks = spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
        found = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", blocks)
        return sum(bool(re.search(r"\btext#|\bsaid#", columns)) for columns in found)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert wide_exchanges(True) == 1
        assert wide_exchanges(False) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
