"""A spread of named queries equals its SQL on the smallest tables."""

import pytest

from check import difference, oracle_frame
from tideline import catalog

NAMES = [
    "m_parse_audit", "m_key_inversions", "m_snapshot", "m_history", "m_features", "m_training_rows", "p_rank_metrics",
    "p_features", "c_history", "c_peer_stats", "t_entity_history", "t_labels", "classification_metrics", "cluster_bootstrap",
    "rank_bootstrap",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, root, name):
    got = catalog.queries()[name](spark, root).toPandas()
    assert difference(got, oracle_frame(catalog.oracles()[name], root)) is None


def test_every_oracle_has_a_query():
    assert set(catalog.oracles()) <= set(catalog.queries())


def test_flagship_has_rows(spark, root):
    assert catalog.flagship(spark, root).count() > 0
