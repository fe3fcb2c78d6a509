import json
import math
import random

import pytest
from pyspark.sql import functions as F

from textguard.functions import decisions as D
from textguard.operators import classifier as CL
from textguard.operators import metrics as M
from textguard.operators import ranking as RK
from textguard.operators import training_data as TD
from textguard.sources import models
from textguard.sources.training_log import evaluations, read_training_log


def test_grouped_rank_equals_a_window_rank(spark):
    ids = random.Random(1).sample(range(5000), 700)
    # two thirds of all rows in one group
    rows = spark.createDataFrame(
        [(i, "hot" if n % 3 else "cold") for n, i in enumerate(ids)], "id long, g string"
    )
    ranked = RK.grouped_rank(rows, ["g"], ["id"])
    got = {r.id: r.rn for r in ranked.collect()}
    want = {}
    for group in ("hot", "cold"):
        mine = sorted(i for n, i in enumerate(ids) if (n % 3 != 0) == (group == "hot"))
        want |= {i: n + 1 for n, i in enumerate(mine)}
    assert got == want


@pytest.fixture(scope="module")
def corpora(spark):
    hostile = spark.createDataFrame(
        [(i, "" if i == 3 else f"attack {i}") for i in range(1, 40)], "doc_id long, text string"
    )
    benign = spark.createDataFrame(
        [(1000 + i, None if i == 5 else f"weather {i}") for i in range(1, 90)],
        "doc_id long, text string",
    )
    return hostile, benign


def test_preparation(corpora):
    rows = sorted(TD.prepare(*corpora, benign_cap=60).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(76))
    assert [r.label for r in rows] == [1, 0] * 38
    assert [r.doc_id for r in rows[:6]] == [1, 1001, 2, 1002, 4, 1003]
    assert sum(r.is_eval for r in rows) == math.ceil(76 * 0.2)
    by_class = [sum(r.is_eval for r in rows if r.label == c) for c in (0, 1)]
    assert sorted(by_class) == [8, 8]


def test_cap_is_by_key_order(corpora):
    kept = sorted(r.doc_id for r in TD.first_rows(corpora[1], 10).collect())
    assert kept == list(range(1001, 1011))


def test_one_class_alone_balances_to_nothing(corpora):
    only = TD.with_label(corpora[0], TD.JAILBREAK)
    assert TD.balance(only).count() == 0


def test_tokens(spark):
    rows = spark.createDataFrame([("Ab, c1!  É" + " x" * 200,)], "text string")
    cut = TD.tokenise(rows, max_tokens=TD.MAX_TOKENS)
    assert cut.columns == ["tokens"]
    tokens = cut.first().tokens
    assert tokens[:3] == ["ab", "c1", "é"] and len(tokens) == 128
    assert len(TD.tokenise(rows).first().tokens) == 203


def by_hand(pairs):
    n = len(pairs)
    per = {}
    for c in (0, 1):
        hit = sum(a == c and b == c for a, b in pairs)
        said, true = sum(b == c for _, b in pairs), sum(a == c for a, _ in pairs)
        p, r = (hit / said if said else 0.0), (hit / true if true else 0.0)
        per[c] = (p, r, 2 * p * r / (p + r) if p + r else 0.0, true)
    weigh = lambda k: sum(v[k] * v[3] for v in per.values()) / n
    return [sum(a == b for a, b in pairs) / n, weigh(2), weigh(0), weigh(1), per[1][2]]


@pytest.mark.parametrize(
    "pairs",
    [
        [(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)],
        [(0, 0), (1, 0), (1, 0)],
        [(0, 0), (0, 0)],
        [(1, 0), (0, 1)],
    ],
)
def test_metrics_row(spark, pairs):
    rows = spark.createDataFrame(pairs, "label int, pred int")
    assert list(M.compute_metrics(rows).first()) == pytest.approx(by_hand(pairs))


def test_decisions(spark):
    rows = spark.createDataFrame(
        [(0.18, 0.82), (0.05, 0.95), (0.95, 0.05), (0.5, 0.5), (None, None)],
        "p0 double, p1 double",
    )
    p0, p1 = F.col("p0"), F.col("p1")
    got = rows.select(
        D.by_threshold(p1),
        D.by_threshold(p1, D.TRAINING_THRESHOLD),
        D.gate_blocks(p0, p1),
        D.gate_blocks(p0, p1, any_class=True),
        D.arg_max(F.array(p0, p1)),
        D.refusal(D.by_threshold(p1)).isNotNull(),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("JAILBREAK", "BENIGN", False, False, 1, True),
        ("JAILBREAK", "JAILBREAK", True, True, 1, True),
        ("BENIGN", "BENIGN", False, True, 0, False),
        ("BENIGN", "BENIGN", False, False, 0, False),
        (None, None, None, None, None, False),
    ]


def test_training_log(spark, tmp_path):
    scores = [0.90, 0.95, 0.93, 0.95, 0.91, 0.97]
    events = []
    for i, f1 in enumerate(scores, 1):
        events.append({"epoch": i - 0.5, "step": 100 * i - 50, "loss": 1.0 / i})
        events.append(
            {"epoch": float(i), "step": 100 * i, "eval_accuracy": f1, "eval_f1_positive_class": f1}
        )
    path = tmp_path / "state.json"
    path.write_text(json.dumps({"best_metric": 0.97, "log_history": events}, indent=2))
    log = read_training_log(spark, str(path))
    assert log.count() == 12 and evaluations(log).count() == 6
    metric = "eval_f1_positive_class"
    assert tuple(M.best_step(log, metric).first()) == (600, 0.97)
    early = log.filter("step <= 500")
    assert tuple(M.best_step(early, metric).first()) == (200, 0.95)  # the earliest best
    assert M.early_stop_step(log, metric).first()[0] == 500
    assert M.early_stop_step(log.filter("step <= 400"), metric).first()[0] is None


def test_classifier_trains_scores_saves_and_loads(spark, corpora, tmp_path):
    rows = TD.prepare(*corpora).cache()
    model = CL.train(rows.filter("NOT is_eval").select("text", "label"), features=1 << 10)
    result = CL.evaluate(rows.filter("is_eval"), model).first()
    assert result.accuracy == 1.0
    path = str(tmp_path / "model")
    models.save_model(model, path)
    again = models.load_model(path)
    texts = spark.createDataFrame([(1, "attack 7"), (2, "weather"), (3, None)], "id long, text string")
    first, second = CL.score(texts, model).collect(), CL.score(texts, again).collect()
    assert sorted(first) == sorted(second)
    by_id = {r.id: r for r in first}
    assert by_id[1].p1 > 0.5 > by_id[2].p1 and by_id[3].p1 is None
    assert by_id[1].p0 + by_id[1].p1 == pytest.approx(1.0)
    renamed = CL.score(texts.withColumnRenamed("text", "body"), model, text="body")
    assert renamed.columns == ["id", "body", "p0", "p1"]
    assert {r.id: r.p1 for r in renamed.collect()} == {r.id: r.p1 for r in first}
