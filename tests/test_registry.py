"""Every query has a callable; a sample runs against its oracle on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "wage_issues", "field_findings", "deadlines_sorted", "capped_scores", "contract_numbering", "clause_matches",
    "cross_conflicts", "extract_fields", "clause_boxes", "law_by_refs", "src_payroll_csv", "quota_24h", "reply_validate",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_against_oracle(spark, name):
    ok, note = check.compare(spark, check.connect(SF), name, SF)
    assert ok, note
