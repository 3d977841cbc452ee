"""Every query that has SQL agrees with it at the smallest scale; the others are compared in other files."""

import importlib

import pytest
from oracle import compare, connect

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) == ""


#: Queries without SQL, and where each is held against a plain version.
TESTED_ELSEWHERE = {
    "g13_field_vectors": "test_kernels", "g14_group_gaussian": "test_kernels", "g15_truncated_svd": "test_kernels", "g16_numeric_rank": "test_kernels",
    "j13_greedy_matching": "test_matching", "j15_assignment": "test_metrics", "k08_diverse_selection": "test_derangements", "l09_landmark_ridge": "test_linear",
    "l09c_interaction_ridge": "test_linear", "l12_field_readout": "test_linear", "l15_balanced_derangements": "test_derangements", "l16_mapping_quality": "test_derangements",
    "l25_text_encoder": "test_encoders",
}


def test_every_query_is_compared():
    assert set(QUERIES) - set(SQL) == set(TESTED_ELSEWHERE)
    for file in set(TESTED_ELSEWHERE.values()):
        importlib.import_module(file)
