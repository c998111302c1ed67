"""Queries that SQL can express against their statements; every query reads whole tables."""

from __future__ import annotations

import os

import pytest

from tests.compare import difference, duck
from tillroll.llm.queries import ORACLE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op9_decontaminate", "op13_whitening"}))
def test_query_returns_every_document(spark, con, name):
    ids = sorted(r["doc_id"] for r in QUERIES[name](spark, SF_DIR).select("doc_id").collect())
    assert ids == [r[0] for r in con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
