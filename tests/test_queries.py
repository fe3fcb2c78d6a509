"""Every registered query runs; where it has SQL, both give the same rows."""

import pytest

import __spark_entry__ as entry_point
from check_oracles import compare, connect
from textguard.plans.catalog import QUERIES

# Long ones over many forms of each document; `check_oracles.py` runs them all.
LONG = {
    "word_types",
    "whole_text_types",
    "words_per_encoding",
    "encoded_positions",
    "run_threshold",
    "same_encoding_threshold",
    "run_flag",
    "same_encoding_flag",
    "flag_reasons",
    "word_totals",
    "longest_encoded_run",
    "obfuscation_flag",
    "classifier_scores",
    "classifier_saved_and_loaded",
    "guard_with_fitted_classifier",
    "blocked_by_obfuscation",
    "verdicts_and_outputs",
    "guard_stream",
}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LONG))
def test_query_agrees_with_sql(spark, sf, con, name):
    agrees, note, _, _ = compare(spark, con, sf, name)
    assert agrees, note


def test_entry(spark):
    rows = entry_point.entry(spark)
    assert rows.columns == ["source", "variant", "whole_type", "n"]
    assert rows.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
