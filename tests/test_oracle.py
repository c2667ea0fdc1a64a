"""Registered queries against their SQL twins; ``ALL_QUERIES=1`` runs every one."""

import os

import pytest
from oracle_check import compare, duck

from probita.plans import registry

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
CHOSEN = [
    "w4_top_cases", "r14_risk_assessment", "j3_client_transfers", "w6_case_status", "w8_score_velocity", "s7_sanctions_list",
    "s13_extract_records", "p13_birth_dates", "q3_issue_rows", "a4_quality_report", "v6_minimized_for_review", "e3_batch_screen",
    "w2_candidate_counts", "j7_light_search", "t2_injection", "t5_claims", "t8_egress", "t10_regulation_search", "j8_verified_citations",
    "g3_descendants", "g3_nodes_traversed", "l3_hash_chain", "l4_verify_chain", "m1_windowed_statistics", "m4_chained_stream",
]
NAMES = list(registry.oracle_sql()) if os.environ.get("ALL_QUERIES") else CHOSEN


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, connection, name):
    assert compare(spark, connection, name, FOLDER) is None


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
