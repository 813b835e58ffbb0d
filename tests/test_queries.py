"""Every registered query of the commerce operators against its SQL over whole small tables."""

import pytest
from oracle import SMALL, compare

from cartlake.catalogue import ORACLES, QUERIES

SLOW = {"churn_champion", "churn_scores", "churn_holdout_predictions"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, name):
    assert compare(spark, SMALL, QUERIES[name], ORACLES.get(name)) == ""


def test_champion_scores(spark):
    """The best of the compared models scores all customers and the test dates."""
    best = QUERIES["churn_champion"](spark, SMALL).collect()
    rows = QUERIES["churn_scores"](spark, SMALL).collect()
    held = QUERIES["churn_holdout_predictions"](spark, SMALL)
    assert [r.model for r in best] == list({r.model_name for r in rows})
    assert all(0 <= r.churn_probability <= 1 and r.risk_band in ("CRITICAL", "HIGH", "MEDIUM", "LOW") for r in rows)
    hits = held.where("churned = churn_prediction").count()
    assert hits == best[0].tp + best[0].tn and held.count() == sum(best[0][k] for k in ("tp", "fp", "tn", "fn"))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
