import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from textguard.operators import metrics as M
from textguard.operators import term_model as TM
from textguard.sources.training_log import evaluations, read_training_log

SCHEMA = "doc_id long, text string, label int, is_eval boolean"


def examples():
    rng = random.Random(3)
    rows = []
    for i in range(160):
        hostile = i % 2
        words = rng.choices(["ordinary", "words", "of", "the", "day", "Sun", "rain"], k=rng.randint(0, 9))
        if hostile and rng.random() < 0.8:
            words += rng.choices(["fool", "IDIOT", "scum"], k=2)
        elif rng.random() < 0.1:
            words.append("fool")
        rng.shuffle(words)
        rows.append((i, " ".join(words), hostile, i % 5 == 0))
    return rows


def slot(word):
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16)


def slow_training(rows, settings):
    words = {i: [slot(w) for w in set(re.findall(r"[^\W_]+", text.lower()))] for i, text, _, _ in rows}
    train = [r for r in rows if not r[3]]
    hostile = sum(r[2] for r in train)
    counts = {}
    for i, _, label, _ in train:
        for s in words[i]:
            counts.setdefault(s, [0, 0])[label] += 1
    ratio = {
        s: math.log((c[1] + 1) / (hostile + 2)) - math.log((c[0] + 1) / (len(train) - hostile + 2)) for s, c in counts.items()
    }

    def features(i):
        own = [s for s in words[i] if s in ratio]
        norm = math.sqrt(sum(ratio[s] ** 2 for s in own))
        return ([(s, ratio[s] / norm) for s in own] if norm else []) + [(TM.CONSTANT, 1.0)]

    x = {r[0]: features(r[0]) for r in rows}
    curve = {}
    for r in train:
        for s, v in x[r[0]]:
            curve[s] = curve.get(s, 0) + 0.25 * v * v / len(train)
    weight, velocity, out = dict.fromkeys(curve, 0.0), dict.fromkeys(curve, 0.0), []
    p = {r[0]: 0.5 for r in rows}
    for _ in range(settings.epochs):
        slope = dict.fromkeys(curve, 0.0)
        for i, _, label, _ in train:
            for s, v in x[i]:
                slope[s] += v * (p[i] - label) / len(train)
        for s in curve:
            velocity[s] = settings.momentum * velocity[s] - settings.step * slope[s] / (curve[s] + settings.damping)
            weight[s] += velocity[s]
        p = {r[0]: 1 / (1 + math.exp(-sum(v * weight.get(s, 0) for s, v in x[r[0]]))) for r in rows}
        out.append((dict(weight), {r[0]: (r[2], p[r[0]] > 0.5) for r in rows if r[3]}))
    return ratio, out


def f1(judged):
    tp = sum(label and pred for label, pred in judged)
    return 2 * tp / max(1, 2 * tp + sum(label != pred for label, pred in judged))


def test_training_matches_the_plain_loop(spark):
    rows = examples()
    settings = TM.Training(epochs=4, patience=9)
    done = TM.train_with_evaluation(spark.createDataFrame(rows, SCHEMA).repartition(3), settings=settings)
    ratio, epochs = slow_training(rows, settings)
    marks = [f1(judged.values()) for _, judged in epochs]
    logged = [e for e in done.log if "eval_f1_positive_class" in e]
    assert [e["eval_f1_positive_class"] for e in logged] == pytest.approx(marks)
    assert done.best_step == marks.index(max(marks)) + 1 and done.best_metric == pytest.approx(max(marks))
    weights = epochs[done.best_step - 1][0]
    got = {r.slot: (r.ratio, r.weight) for r in done.model.weights.collect()}
    assert set(got) == set(weights)
    for s, (r, w) in got.items():
        assert r == pytest.approx(ratio.get(s, 0.0)) and w == pytest.approx(weights[s])
    losses = [e["loss"] for e in done.log if "loss" in e]
    assert losses[-1] < losses[0]


def test_scores_keep_every_text_and_survive_saving(spark, tmp_path):
    frame = spark.createDataFrame(examples(), SCHEMA)
    model = TM.train_with_evaluation(frame).model
    model.save(str(tmp_path / "m"))
    again = TM.TermModel.load(spark, str(tmp_path / "m"))
    texts = spark.createDataFrame(
        [(1, "you idiot scum"), (2, "the sun"), (3, None), (4, ""), (5, "unknown"), (6, "IDIOT " * 50_000)], "id long, body string"
    )
    first = {r.id: (r.p0, r.p1) for r in TM.score(texts, model, "id", "body").collect()}
    assert first == {r.id: (r.p0, r.p1) for r in TM.score(texts, again, "id", "body").collect()}
    assert set(first) == {1, 2, 4, 5, 6} and first[4] == first[5]
    assert first[1][1] > 0.5 > first[2][1] and first[6][1] > 0.5
    assert all(sum(p) == pytest.approx(1) for p in first.values())
    held = frame.where("is_eval")
    judged = TM.score(held, model, "doc_id").join(held, "doc_id").selectExpr("label", "int(p1 > p0) as pred")
    assert TM.evaluate(held, model).collect() == M.compute_metrics(judged).collect()


def test_training_stops_and_keeps_the_best(spark):
    rows = examples()
    done = TM.train_with_evaluation(spark.createDataFrame(rows, SCHEMA), settings=TM.Training(epochs=30, patience=2))
    marks = [e["eval_f1_positive_class"] for e in done.log if "eval_f1_positive_class" in e]
    assert len(marks) < 30 and marks[done.best_step - 1] == max(marks)
    assert len(marks) == done.best_step + 2


def test_parts_that_are_missing(spark):
    frame = spark.createDataFrame(examples(), SCHEMA)
    untested = TM.train_with_evaluation(frame.withColumn("is_eval", F.lit(False)), settings=TM.Training(epochs=2))
    assert untested.best_step == 1 and untested.best_metric == 0
    nothing = TM.train_with_evaluation(frame.limit(0), settings=TM.Training(epochs=1))
    scores = TM.score(frame, nothing.model, "doc_id").collect()
    assert len(scores) == 160 and all(r.p1 == 0.5 for r in scores)


def test_logs_of_two_runs_stay_apart(spark, tmp_path):
    model = TM.TermModel(spark.createDataFrame([(1, 0.0, 0.0)], "slot int, ratio double, weight double"))

    def run(name, scores):
        log = []
        for i, mark in enumerate(scores, 1):
            log += [{"epoch": float(i), "step": i, "loss": 1.0 / i}]
            log += [{"epoch": float(i), "step": i, "eval_accuracy": mark, "eval_f1_positive_class": mark}]
        done = TM.Trained(model, log, scores.index(max(scores)) + 1, max(scores))
        TM.write_log(spark, done, str(tmp_path / name))

    run("a", [0.5, 0.9, 0.8, 0.7, 0.6])
    run("b", [0.1, 0.2, 0.95])
    log = read_training_log(spark, str(tmp_path))
    assert log.count() == 16 and log.columns[:2] == ["run", "step"]
    marks = evaluations(log)
    metric = "eval_f1_positive_class"
    best = {r.run: (r.best_step, r.best_metric) for r in M.best_step(marks, metric, by=["run"]).collect()}
    assert best == {"a": (2, 0.9), "b": (3, 0.95)}
    stops = {r.run: r.stop_step for r in M.early_stop_step(marks, metric, by=["run"]).collect()}
    assert stops == {"a": 5, "b": None}
