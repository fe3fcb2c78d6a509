"""Queries over labelled text: preparation, decisions, metrics, the fitted classifier.

Documents labelled toxic stand in for hostile prompts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import decisions as D
from textguard.operators import classifier as CL
from textguard.operators import metrics as M
from textguard.operators import term_model as TM
from textguard.operators import training_data as TD
from textguard.plans.catalog.registry import register
from textguard.sources import tables as T
from textguard.sources.shared import shared_folder
from textguard.sources.tables import read_labelled, read_table, spread, turn_id
from textguard.sources.training_log import evaluations, read_training_log

# A short list, so that predictions are neither all right nor all wrong.
HOSTILE_WORDS = ["clown", "idiot", "loser", "moron", "stupid"]


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"


def hits_sql(text: str, words: list[str] = HOSTILE_WORDS) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter({tokens_sql(text)}, lambda w: w IN ({listed})))"


def labelled(spark, folder, reads_texts: bool = False) -> DataFrame:
    """Labelled documents, over all cores where the query works on the texts."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text")
    if reads_texts:
        documents = spread(documents)
    return read_labelled(documents, read_table(spark, folder, "labels"), "toxic")


LABELLED_SQL = """
    labelled AS (SELECT doc_id, text, toxic AS label FROM documents JOIN labels USING (doc_id))"""


@register(
    "read_messages",
    """SELECT 'documents' AS source, doc_id::VARCHAR AS msg_id, md5(text) AS digest FROM documents
       UNION ALL
       SELECT 'conversations', conv_id || ':' || turn, md5(text) FROM conversations""",
)
def read_messages(spark, folder):
    docs = T.read_messages(spark, f"{folder}/documents.parquet", "doc_id").select(
        F.lit("documents").alias("source"), F.col("msg_id").cast("string").alias("msg_id"), "text"
    )
    turns = T.read_messages(spark, f"{folder}/conversations.parquet", "conv_id", "conv_id", "turn").select(
        F.lit("conversations").alias("source"), turn_id().alias("msg_id"), "text"
    )
    both = docs.unionByName(turns)
    return both.select("source", "msg_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@register(
    "read_labelled_corpora",
    f"""WITH {LABELLED_SQL}
        SELECT label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM labelled GROUP BY ALL""",
)
def read_labelled_corpora(spark, folder):
    return labelled(spark, folder).groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )


_PROMPT = "CASE quality WHEN 1 THEN text WHEN 0 THEN '' END"


@register(
    "drop_empty_prompts",
    f"""SELECT doc_id, md5(prompt) AS digest
        FROM (SELECT doc_id, {_PROMPT} AS prompt FROM documents LEFT JOIN labels USING (doc_id))
        WHERE prompt IS NOT NULL AND prompt <> ''""",
)
def drop_empty_prompts(spark, folder):
    rows = read_table(spark, folder, "documents").join(
        read_table(spark, folder, "labels"), "doc_id", "left"
    )
    prompts = rows.select("doc_id", F.expr(_PROMPT).alias("prompt"))
    kept = TD.drop_empty(prompts, "prompt")
    return kept.select("doc_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


@register(
    "attach_class_label",
    """SELECT doc_id, 1 AS label FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
       UNION ALL
       SELECT doc_id, 0 FROM documents JOIN labels USING (doc_id) WHERE toxic = 0""",
)
def attach_class_label(spark, folder):
    rows = labelled(spark, folder)
    hostile = TD.with_label(rows.filter("label = 1").select("doc_id"), TD.JAILBREAK)
    benign = TD.with_label(rows.filter("label = 0").select("doc_id"), TD.BENIGN)
    return hostile.unionByName(benign)


@register(
    "first_benign_rows",
    f"""WITH {LABELLED_SQL}
        SELECT doc_id FROM labelled WHERE label = 0 ORDER BY doc_id LIMIT 600""",
)
def first_benign_rows(spark, folder):
    benign = labelled(spark, folder).filter(F.col("label") == TD.BENIGN)
    return TD.first_rows(benign.select("doc_id"), TD.BENIGN_CAP)


BALANCED_SQL = f"""{LABELLED_SQL},
    numbered AS (
      SELECT doc_id, text, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rn
      FROM labelled
    ),
    balanced AS (
      SELECT * FROM numbered
      WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY label))
    )"""


@register("balance_classes", f"WITH {BALANCED_SQL} SELECT doc_id, label, rn FROM balanced")
def balance_classes(spark, folder):
    return TD.balance(labelled(spark, folder).select("doc_id", "label"))


@register(
    "interleave_classes",
    f"""WITH {BALANCED_SQL}
        SELECT doc_id, label, row_number() OVER (ORDER BY rn, label DESC) - 1 AS position
        FROM balanced""",
)
def interleave_classes(spark, folder):
    balanced = TD.balance(labelled(spark, folder).select("doc_id", "label"))
    return TD.interleave(balanced).drop("rn")


@register(
    "cast_label",
    "SELECT doc_id, CAST(CAST(toxic AS VARCHAR) AS INTEGER) AS label FROM labels",
)
def cast_label(spark, folder):
    written = read_table(spark, folder, "labels").select(
        "doc_id", F.col("toxic").cast("string").alias("label")
    )
    return TD.with_label(written, F.col("label"))


def split_sql(source: str) -> str:
    """CTE ``split(doc_id, label, is_eval)`` over ``source``."""
    return f"""
    sizes AS (SELECT label, count(*) AS n FROM {source} GROUP BY ALL),
    target AS (SELECT ceil(sum(n) * 0.2) AS want, sum(n) AS total FROM sizes),
    shares AS (SELECT label, floor(n * want / total) AS whole,
                      n * want / total - floor(n * want / total) AS rest, want
               FROM sizes, target),
    quota AS (
      SELECT label, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
                                      <= want - sum(whole) OVER () THEN 1 ELSE 0 END AS take
      FROM shares
    ),
    split AS (
      SELECT doc_id, label, row_number() OVER (PARTITION BY label
               ORDER BY md5('42:' || doc_id), doc_id) <= take AS is_eval
      FROM {source} JOIN quota USING (label)
    )"""


@register(
    "stratified_split",
    f"WITH {LABELLED_SQL}, {split_sql('labelled')} SELECT doc_id, label, is_eval FROM split",
)
def stratified_split(spark, folder):
    return TD.stratified_split(labelled(spark, folder).select("doc_id", "label"))


@register(
    "tokens_cut_at_128",
    f"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
        FROM (SELECT doc_id, {tokens_sql('text')}[1:128] AS t FROM documents)""",
)
def tokens_cut_at_128(spark, folder):
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text"))
    cut = docs.select("doc_id", TD.tokens(F.col("text"), TD.MAX_TOKENS).alias("t"))
    return cut.select(
        "doc_id",
        F.size("t").alias("n_tokens"),
        F.md5(F.array_join("t", " ").cast("binary")).alias("digest"),
    )


@register(
    "tokenised_examples",
    f"""WITH {LABELLED_SQL}
        SELECT doc_id, label, array_to_string({tokens_sql('text')}, ' ') AS tokens
        FROM labelled""",
)
def tokenised_examples(spark, folder):
    rows = TD.tokenise(labelled(spark, folder, True))
    return rows.withColumn("tokens", F.array_join("tokens", " "))


def training_set(spark, folder) -> DataFrame:
    rows = labelled(spark, folder)
    return TD.prepare(
        rows.filter("label = 1").drop("label"), rows.filter("label = 0").drop("label")
    )


_CAPPED = LABELLED_SQL.replace(
    "JOIN labels USING (doc_id))",
    "JOIN labels USING (doc_id) WHERE text <> '' QUALIFY toxic = 1 OR "
    "row_number() OVER (PARTITION BY toxic ORDER BY doc_id) <= 600)",
)


@register(
    "training_set",
    f"""WITH {BALANCED_SQL.replace(LABELLED_SQL, _CAPPED)}, {split_sql('balanced')}
        SELECT doc_id, label, 2 * rn - 1 - label AS position, is_eval
        FROM balanced JOIN split USING (doc_id, label)""",
)
def prepared_training_set(spark, folder):
    return training_set(spark, folder).select("doc_id", "label", "position", "is_eval")


# --- decisions and metrics over the word-list scorer ----------------------
def scored(spark, folder) -> DataFrame:
    scorer = CL.word_list_scorer(HOSTILE_WORDS)
    return scorer(labelled(spark, folder, True), "text").select("doc_id", "label", "p0", "p1")


SCORED_SQL = f"""{LABELLED_SQL},
    scored AS (SELECT doc_id, label, pow(0.5, hits) AS p0, 1 - pow(0.5, hits) AS p1, hits
               FROM (SELECT doc_id, label, {hits_sql('text')} AS hits FROM labelled))"""


@register("word_list_scores", f"WITH {SCORED_SQL} SELECT doc_id, label, p0, p1 FROM scored")
def word_list_scores(spark, folder):
    return scored(spark, folder)


@register(
    "decide_by_threshold",
    f"""WITH {SCORED_SQL}
        SELECT doc_id, CASE WHEN p1 >= 0.82 THEN 'JAILBREAK' ELSE 'BENIGN' END AS scoring,
               CASE WHEN p1 >= 0.9 THEN 'JAILBREAK' ELSE 'BENIGN' END AS training FROM scored""",
)
def decide_by_threshold(spark, folder):
    return scored(spark, folder).select(
        "doc_id",
        D.by_threshold(F.col("p1")).alias("scoring"),
        D.by_threshold(F.col("p1"), D.TRAINING_THRESHOLD).alias("training"),
    )


@register(
    "gate_decision",
    f"""WITH {SCORED_SQL}
        SELECT doc_id, greatest(p0, p1) > 0.82 AS any_class, p1 > 0.82 AS hostile_class FROM scored""",
)
def gate_decision(spark, folder):
    p0, p1 = F.col("p0"), F.col("p1")
    return scored(spark, folder).select(
        "doc_id",
        D.gate_blocks(p0, p1, any_class=True).alias("any_class"),
        D.gate_blocks(p0, p1).alias("hostile_class"),
    )


@register(
    "refusal_lines",
    f"""WITH {SCORED_SQL}
        SELECT doc_id, CASE WHEN p1 >= 0.82 THEN '{D.REFUSAL}' END AS line FROM scored""",
)
def refusal_lines(spark, folder):
    return scored(spark, folder).select(
        "doc_id", D.refusal(D.by_threshold(F.col("p1"))).alias("line")
    )


PREDICTED_SQL = f"""{SCORED_SQL},
    predicted AS (SELECT doc_id, label, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS pred FROM scored)"""


def predicted(spark, folder) -> DataFrame:
    return scored(spark, folder).select(
        "doc_id", "label", D.arg_max(F.array("p0", "p1")).alias("pred")
    )


@register("arg_max_class", f"WITH {PREDICTED_SQL} SELECT doc_id, label, pred FROM predicted")
def arg_max_class(spark, folder):
    return predicted(spark, folder)


def metrics_sql(source: str, by: str = "") -> str:
    """CTE ``metrics`` by per-class rows, supports as weights."""
    keys = f"{by}, " if by else ""
    join = f"USING ({by})" if by else "ON true"
    return f"""
    per_class AS (
      SELECT {keys}c, count(*) FILTER (label = c AND pred = c) AS hit,
             count(*) FILTER (label <> c AND pred = c) AS alarm,
             count(*) FILTER (label = c AND pred <> c) AS miss
      FROM {source}, (VALUES (0), (1)) AS classes(c) GROUP BY ALL
    ),
    rated AS (
      SELECT *, hit + miss AS support,
             coalesce(hit / nullif(hit + alarm, 0), 0) AS prec,
             coalesce(hit / nullif(hit + miss, 0), 0) AS rec,
             coalesce(2 * hit / nullif(2 * hit + alarm + miss, 0), 0) AS f1
      FROM per_class
    ),
    metrics AS (
      SELECT {keys}sum(hit) / sum(support) AS accuracy,
             sum(f1 * support) / sum(support) AS f1_weighted,
             sum(prec * support) / sum(support) AS precision_weighted,
             sum(rec * support) / sum(support) AS recall_weighted,
             max(f1) FILTER (c = 1) AS f1_positive_class
      FROM rated {'GROUP BY ' + by if by else ''}
    )"""


_METRICS = {
    "accuracy": M.accuracy,
    "f1_weighted": M.f1_weighted,
    "precision_weighted": M.precision_weighted,
    "recall_weighted": M.recall_weighted,
    "f1_positive_class": M.f1_positive_class,
}


def _single_metric(name: str, build) -> None:
    @register(
        f"metric_{name}",
        f"WITH {PREDICTED_SQL}, {metrics_sql('predicted')} "
        f"SELECT round({name}, 9) AS {name} FROM metrics",
    )
    def query(spark, folder):
        return M.confusion(predicted(spark, folder)).select(F.round(build(), 9).alias(name))


for _name, _build in _METRICS.items():
    _single_metric(_name, _build)

_ROUNDED = ", ".join(f"round({m}, 9) AS {m}" for m in _METRICS)


def _rounded() -> list[Column]:
    return [F.round(m, 9).alias(m) for m in _METRICS]


@register(
    "metrics_row",
    f"WITH {PREDICTED_SQL}, {metrics_sql('predicted')} SELECT {_ROUNDED} FROM metrics",
)
def metrics_row(spark, folder):
    return M.compute_metrics(predicted(spark, folder)).select(*_rounded())


# --- choices over a metric log --------------------------------------------
STEPS = 8


def metric_log(spark, folder) -> DataFrame:
    """One evaluation per step: at step k a text is hostile from k listed words on."""
    hits = labelled(spark, folder, True).select(
        "label", D.listed_word_hits(F.col("text"), HOSTILE_WORDS).alias("hits")
    )
    judged = hits.select(
        "label", "hits", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step")
    ).select("step", "label", (F.col("hits") >= F.col("step")).cast("int").alias("pred"))
    return M.compute_metrics(judged, ["step"])


_LOG_SQL = f"""{SCORED_SQL},
    judged AS (SELECT step, label, CASE WHEN hits >= step THEN 1 ELSE 0 END AS pred
               FROM scored, generate_series(1, {STEPS}) AS steps(step)),
    {metrics_sql('judged', 'step')}"""


@register(
    "best_step_by_metric",
    f"""WITH {_LOG_SQL}
        SELECT step AS best_step, round(f1_positive_class, 9) AS best_metric FROM metrics
        ORDER BY f1_positive_class DESC, step LIMIT 1""",
)
def best_step_by_metric(spark, folder):
    best = M.best_step(metric_log(spark, folder), "f1_positive_class")
    return best.withColumn("best_metric", F.round("best_metric", 9))


@register(
    "early_stop_step",
    f"""WITH {_LOG_SQL},
        marked AS (
          SELECT step, coalesce(f1_positive_class > max(f1_positive_class) OVER (ORDER BY step
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM metrics
        )
        SELECT min(step) AS stop_step FROM (
          SELECT step, step - max(CASE WHEN better THEN step END) OVER (ORDER BY step) AS stale
          FROM marked) WHERE stale >= 3""",
)
def early_stop_step(spark, folder):
    return M.early_stop_step(metric_log(spark, folder), "f1_positive_class")


# --- the classifier, trained and evaluated --------------------------------
SETTINGS = TM.Training()


def trained(spark, folder) -> tuple[DataFrame, TM.Trained]:
    """The prepared examples and the classifier trained on them."""
    rows = training_set(spark, folder).select("doc_id", "text", "label", "is_eval")
    return rows, TM.train_with_evaluation(rows, settings=SETTINGS)


def _words_sql(source: str, *kept: str) -> str:
    names = "".join(f"{k}, " for k in kept)
    return f"""(SELECT {names}('0x' || substr(md5(word), 1, 4))::INTEGER AS slot
      FROM (SELECT {names}unnest(list_distinct({tokens_sql('text')})) AS word FROM {source}))"""


def _epoch_sql(e: int) -> str:
    return f"""
    slopes{e} AS (
      SELECT slot, sum(x * (p1 - f.label)) / any_value(n) AS slope
      FROM model_features f JOIN predicted{e - 1} USING (doc_id), class_sizes WHERE NOT f.is_eval GROUP BY slot
    ),
    weights{e} AS MATERIALIZED (
      SELECT slot, curve, {SETTINGS.momentum} * velocity - {SETTINGS.step} * slope / (curve + {SETTINGS.damping}) AS velocity,
             weight + {SETTINGS.momentum} * velocity - {SETTINGS.step} * slope / (curve + {SETTINGS.damping}) AS weight
      FROM weights{e - 1} JOIN slopes{e} USING (slot)
    ),
    predicted{e} AS MATERIALIZED (
      SELECT doc_id, label, is_eval, 1 / (1 + exp(-sum(x * weight))) AS p1
      FROM model_features JOIN weights{e} USING (slot) GROUP BY ALL
    ),"""


_EPOCHS = range(1, SETTINGS.epochs + 1)
_EVERY = " UNION ALL ".join(
    f"SELECT {e} AS step, label, is_eval, p1, CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS pred FROM predicted{e}" for e in _EPOCHS
)
_ALL_WEIGHTS = " UNION ALL ".join(f"SELECT {e} AS step, slot, weight FROM weights{e}" for e in _EPOCHS)

#: CTEs ``examples``, ``epochs`` (the metrics of each epoch that ran), ``chosen`` (the best one) and
#: ``model(slot, ratio, weight)``: the whole training, one epoch after another.
TRAINED_SQL = f"""{BALANCED_SQL.replace(LABELLED_SQL, _CAPPED)}, {split_sql('balanced')},
    examples AS MATERIALIZED (
      SELECT doc_id, text, label, is_eval FROM split JOIN balanced USING (doc_id, label)
    ),
    example_words AS MATERIALIZED (SELECT * FROM {_words_sql('examples', 'doc_id', 'label', 'is_eval')}),
    class_sizes AS (
      SELECT count(*) AS n, count(*) FILTER (label = 1) AS hostile, count(*) FILTER (label = 0) AS benign
      FROM examples WHERE NOT is_eval
    ),
    model_ratios AS MATERIALIZED (
      SELECT slot, ln((count(*) FILTER (label = 1) + 1) / (any_value(hostile) + 2)::DOUBLE)
                   - ln((count(*) FILTER (label = 0) + 1) / (any_value(benign) + 2)::DOUBLE) AS ratio
      FROM example_words, class_sizes WHERE NOT is_eval GROUP BY slot
    ),
    model_norms AS (SELECT doc_id, sqrt(sum(ratio * ratio)) AS norm FROM example_words JOIN model_ratios USING (slot) GROUP BY doc_id),
    model_features AS MATERIALIZED (
      SELECT doc_id, label, is_eval, slot, ratio / norm AS x
      FROM example_words JOIN model_ratios USING (slot) JOIN model_norms USING (doc_id) WHERE norm > 0
      UNION ALL SELECT doc_id, label, is_eval, {TM.CONSTANT}, 1 FROM examples
    ),
    weights0 AS MATERIALIZED (
      SELECT slot, 0.25 * sum(x * x) / any_value(n) AS curve, 0::DOUBLE AS velocity, 0::DOUBLE AS weight
      FROM model_features, class_sizes WHERE NOT is_eval GROUP BY slot
    ),
    predicted0 AS (SELECT doc_id, label, is_eval, 0.5 AS p1 FROM examples),
    {''.join(_epoch_sql(e) for e in _EPOCHS)}
    every_epoch AS MATERIALIZED ({_EVERY}),
    epoch_evaluated AS (SELECT * FROM every_epoch WHERE is_eval),
    {metrics_sql('epoch_evaluated', 'step')},
    epoch_losses AS (
      SELECT step, avg(-ln(greatest(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END, 1e-15))) FILTER (is_eval) AS eval_loss,
             avg(-ln(greatest(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END, 1e-15))) FILTER (NOT is_eval) AS loss
      FROM every_epoch GROUP BY step
    ),
    epochs_marked AS (
      SELECT *, coalesce(f1_positive_class > max(f1_positive_class) OVER (ORDER BY step
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better
      FROM metrics JOIN epoch_losses USING (step)
    ),
    epochs_counted AS (SELECT *, step - max(CASE WHEN better THEN step END) OVER (ORDER BY step) AS stale FROM epochs_marked),
    epochs AS MATERIALIZED (
      SELECT * FROM epochs_counted
      WHERE step <= coalesce((SELECT min(step) FROM epochs_counted WHERE stale >= {SETTINGS.patience}), {SETTINGS.epochs})
    ),
    chosen AS (SELECT step AS best_step, f1_positive_class AS best_metric FROM epochs ORDER BY f1_positive_class DESC, step LIMIT 1),
    model AS MATERIALIZED (
      SELECT slot, coalesce(ratio, 0) AS ratio, weight
      FROM ({_ALL_WEIGHTS}) JOIN chosen ON step = best_step LEFT JOIN model_ratios USING (slot)
    )"""


def model_scores_sql(source: str, key: str) -> str:
    """Rows ``(key, p1)`` for ``source(key, text)`` by the CTE ``model``."""
    return f"""SELECT {key}, 1 / (1 + exp(-(coalesce(dot / nullif(sqrt(square), 0), 0)
                 + (SELECT weight FROM model WHERE slot = {TM.CONSTANT})))) AS p1
      FROM {source} LEFT JOIN (
        SELECT {key}, sum(ratio * weight) AS dot, sum(ratio * ratio) AS square
        FROM {_words_sql(source, key)} JOIN model USING (slot) GROUP BY {key}) USING ({key})
      WHERE text IS NOT NULL"""


def _score(name: str) -> Column:
    return F.round(name, 6).alias(name)


@register(
    "training_log_events",
    f"""WITH {TRAINED_SQL}
        SELECT 'run-a' AS run, step, round(loss, 6) AS loss, NULL::DOUBLE AS eval_loss, NULL::DOUBLE AS eval_accuracy,
               NULL::DOUBLE AS eval_f1_positive_class FROM epochs
        UNION ALL
        SELECT 'run-a', step, NULL, round(eval_loss, 6), round(accuracy, 6), round(f1_positive_class, 6) FROM epochs""",
)
def training_log_events(spark, folder):
    """The log of a training run, written in the trainer's shape and read back."""
    home = shared_folder(spark, "training-log")
    _, done = trained(spark, folder)
    TM.write_log(spark, done, f"{home}/run-a", SETTINGS)
    log = read_training_log(spark, home)
    return log.select(
        "run", "step", _score("loss"), _score("eval_loss"), _score("eval_accuracy"), _score("eval_f1_positive_class")
    )


@register(
    "best_model_step",
    f"""WITH {TRAINED_SQL}
        SELECT 'run-a' AS run, best_step, round(best_metric, 6) AS best_metric,
               (SELECT max(step) FROM epochs) AS last_step,
               (SELECT min(step) FROM epochs WHERE stale >= {SETTINGS.patience}) AS stop_step FROM chosen""",
)
def best_model_step(spark, folder):
    """Of the log as read back: the epoch whose model is kept, and where training stopped."""
    home = shared_folder(spark, "training-log")
    _, done = trained(spark, folder)
    TM.write_log(spark, done, f"{home}/run-a", SETTINGS)
    log = evaluations(read_training_log(spark, home))
    metric = "eval_f1_positive_class"
    last = log.groupBy("run").agg(F.max("step").alias("last_step"))
    stop = M.early_stop_step(log, metric, SETTINGS.patience, by=["run"])
    return M.best_step(log, metric, by=["run"]).withColumn("best_metric", F.round("best_metric", 6)).join(
        last, "run"
    ).join(stop, "run")


@register(
    "classifier_weights",
    f"WITH {TRAINED_SQL} SELECT slot, round(ratio, 6) AS ratio, round(weight, 6) AS weight FROM model",
)
def classifier_weights(spark, folder):
    """The fitted model: a row for each slot."""
    _, done = trained(spark, folder)
    return done.model.weights.select("slot", _score("ratio"), _score("weight"))


@register(
    "classifier_scores",
    f"""WITH {TRAINED_SQL}, scores AS ({model_scores_sql('documents', 'doc_id')})
        SELECT doc_id, round(1 - p1, 6) AS p0, round(p1, 6) AS p1 FROM scores""",
)
def classifier_scores(spark, folder):
    """Every document scored by a model fitted on the training part of the labelled ones."""
    _, done = trained(spark, folder)
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text"))
    return TM.score(docs, done.model, "doc_id").select("doc_id", _score("p0"), _score("p1"))


@register(
    "classifier_evaluation",
    f"WITH {TRAINED_SQL} SELECT {_ROUNDED} FROM epochs JOIN chosen ON step = best_step",
)
def classifier_evaluation(spark, folder):
    """The metrics of the model that was kept, measured again on the eval part."""
    rows, done = trained(spark, folder)
    return TM.evaluate(rows.filter("is_eval"), done.model).select(*_rounded())


@register(
    "classifier_saved_and_loaded",
    f"""WITH {TRAINED_SQL}, scores AS ({model_scores_sql('documents', 'doc_id')})
        SELECT doc_id, CASE WHEN p1 >= 0.82 THEN 'JAILBREAK' ELSE 'BENIGN' END AS decision FROM scores""",
)
def classifier_saved_and_loaded(spark, folder):
    """Decisions of a classifier after a round through shared storage."""
    _, done = trained(spark, folder)
    path = shared_folder(spark, "classifier")
    done.model.save(path)
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "text"))
    scored_docs = TM.score(docs, TM.TermModel.load(spark, path), "doc_id")
    return scored_docs.select("doc_id", D.by_threshold(F.col("p1")).alias("decision"))
