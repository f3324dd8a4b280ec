"""The driver's contract, and every registered query on the smallest tables."""

import os
import shutil
import subprocess
import sys
import tempfile

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline"))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_without_the_llm_folders():
    with tempfile.TemporaryDirectory() as place:
        copy = os.path.join(place, "repo")
        shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
        code = """
import __spark_entry__ as e
q = e.queries()
assert q and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
assert q['t11_word_count'](spark, '/root/testdata/sf0.001').count() == 200
"""
        env = os.environ | {"PYTHONPATH": copy}
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env, timeout=180)
        subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, check=True, env=env, timeout=180, capture_output=True)
