"""Every query with SQL gives the rows that DuckDB gives; the others have tests of their values in test_operators.py."""

import pytest

from lectern.plans import base
from tests.conftest import SF, normal

import __spark_entry__  # noqa: F401  registers all queries

#: Queries that SQL can't express, and the test that holds each one's values against a table, the rules by hand, or held-out rows.
VALUE_TESTS = {
    "wer": "test_error_rates_by_table", "cer": "test_error_rates_by_table", "noise_curve": "test_noise_costs", "search_smart": "test_fuzzy_and_smart_by_hand", "search_fuzzy": "test_fuzzy_and_smart_by_hand",
    "diarization_error": "test_diarization_error_query", "tfidf_baseline": "test_models", "fold_baselines": "test_folds", "measured_noise_limit": "test_measured_noise_limit", "resolved_recordings": "test_resolved_recordings_query", "search_fuzzy_documents": "test_fuzzy_documents_by_brute_force", "search_smart_documents": "test_fuzzy_documents_by_brute_force",
}


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_query(spark, duck, name):
    got = base.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(base.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_queries_without_sql_have_value_tests():
    from tests import test_operators

    assert set(base.QUERIES) - set(base.ORACLES) == set(VALUE_TESTS)
    assert all(hasattr(test_operators, t) for t in VALUE_TESTS.values())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
