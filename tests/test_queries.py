"""Registered queries against their SQL on the smallest test data, where it is there."""

import os
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from tools.compare import connect, difference  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
WITHOUT_SQL: set[str] = set()
OPTIONAL = re.compile(r"op\d+_|pipeline$")  # of a package that can be left out


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_contract(spark):
    assert {n for n in set(contract.queries()) - set(contract.oracle_sql()) if not OPTIONAL.match(n)} == WITHOUT_SQL
    assert not set(contract.oracle_sql()) - set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, con, name):
    assert difference(spark, con, FOLDER, name) in (None, "agree, but no rows")
