"""Every query that SQL can express gives what its SQL gives."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tools.check_oracles import compare, duck

SQLS = oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(queries())


# Fits need more positive rows than the smallest tables have to learn anything.
FITS = {"fit_logistic", "fit_svm", "fit_boosted", "fit_forest_smote", "fit_balanced_forest", "top_features",
        "iforest_scores", "train_and_score_all", "train_three_classes"}


@pytest.mark.parametrize("name", sorted(set(SQLS) - FITS))
def test_query(spark, con, sf, name):
    result = compare(spark, con, sf, name, queries()[name], SQLS[name])
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(FITS))
def test_fit(spark, name):
    larger = "/root/testdata/sf0.01"
    result = compare(spark, duck(larger), larger, name, queries()[name], SQLS[name])
    assert result.startswith("ok"), result
