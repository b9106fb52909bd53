"""Every registered trace query against its SQL on the same tables."""

import pytest
from oracle import DATA, differences

from tracemill.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, QUERIES[name], SQL[name]) == []


#: queries whose results SQL cannot say; tests/test_edges.py and below hold them against plain Python
WITHOUT = {
    "n_eff", "n_eff_by_domain", "rolling_n_eff", "frechet_pairs", "route_labels", "route_rates", "route_clusters", "manifest", "scrub_text", "redaction_counts", "rescrub_report", "scrub_by_level", "scrub_json", "sanitize_json", "payload_digest",
}


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
