"""The entry imports without Spark's jars, a session or DuckDB."""

import os
import subprocess
import sys

from conftest import ROOT

from logloom.functions import fixed_values as fv

_BARE = """
import sys
from pathlib import Path
sys.modules["duckdb"] = None
glob = Path.glob
Path.glob = lambda self, pattern: iter(()) if "jar" in str(pattern) else glob(self, pattern)
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert SparkSession.getActiveSession() is None
assert len(e.queries()) >= len(e.oracle_sql()) > 60
"""


def test_entry_imports_bare():
    env = os.environ | {"SPARK_HOME": "/nowhere", "PYTHONPATH": ROOT}
    subprocess.run([sys.executable, "-c", _BARE], cwd=ROOT, env=env, check=True, timeout=120)


def test_entry_without_a_library_of_the_training_data_queries():
    """The core queries stay where a library is missing that they don't need."""
    code = (
        "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['xxhash'] = None; "
        "import __spark_entry__ as e; names = e.queries(); "
        "assert 'hourly_metrics' in names and not any(n.startswith('op') and n[2].isdigit() for n in names)"
    )
    env = os.environ | {"PYTHONPATH": ROOT}
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, check=True, timeout=120)


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert list(fv.ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")
