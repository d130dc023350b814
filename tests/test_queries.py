"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import entry
from oracle_check import connect, difference, spark_bag, sql_bag
from probelens.plans.continuous_sql import ORACLES
from probelens.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, con, name):
    left = spark_bag(REGISTRY[name](spark, SF_DIR))
    assert difference(left, sql_bag(con, ORACLES[name])) is None
    assert left[1]


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_other_queries_stay_without_the_libraries_of_the_corpus_operators():
    """In a session of its own: imports are blocked, and modules are loaded once."""
    code = """
import sys, warnings
for name in ("ahocorasick", "tokenizers"):
    sys.modules[name] = None
with warnings.catch_warnings(record=True) as told:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
    queries = entry.queries()
    assert set(entry.oracle_sql()) == set(queries) and "check_results" in queries and not [q for q in queries if q.startswith("op")]
    assert any("left out" in str(w.message) for w in told) or not __import__("os").path.isdir("probelens/llm")
"""
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
