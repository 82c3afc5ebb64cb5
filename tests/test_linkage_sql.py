"""Every linkage query that has SQL gives the SQL's rows on the smallest tables."""

import pytest
from oracle import same

from kinlink.plans import queries as Q

SLOW = {"stream_match"}


@pytest.mark.parametrize("name", sorted(set(Q.SQL) - SLOW))
def test_sql(spark, sf, name):
    same(spark, sf, Q.QUERIES[name], Q.SQL[name])


def test_queries_without_sql(spark, sf):
    """Their values are tested in test_features and test_operators; here they run as registered."""
    assert Q.QUERIES["retrieve_sound"](spark, sf).count() >= Q.QUERIES["retrieve_enhanced"](spark, sf).count()
    assert set(Q.QUERIES) - set(Q.SQL) == {"retrieve_sound", "feature_full", "feature_reference", "train_logistic", "train_trees", "match_trees"}
