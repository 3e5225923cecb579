"""Registered queries against their SQL on the small tables (all of them with LECTERN_FULL=1)."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
LINT_SAMPLE = {"lint_v4_e6", "lint_v4_e5", "lint_v3_e2", "lint_v4_km_rel", "lint_v4_sum", "lint_v4o_toc", "lint_version", "lint_v4o_fm"}
# Rules whose findings do not occur in the smallest tables, and the slow forms.
QUIET: set[str] = set()
FULL = os.environ.get("LECTERN_FULL") == "1"
NAMES = [n for n in QUERIES if FULL or not n.startswith("lint_") or n in LINT_SAMPLE]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    problem, _, _ = compare(spark, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert problem is None or name in QUIET, problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
