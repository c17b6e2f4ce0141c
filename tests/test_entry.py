"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_without_training_data_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(n.startswith('op1') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)


def test_entry_without_a_library(tmp_path):
    """A library that only the training-data operators need may be missing."""
    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; assert 'flagship' in e.queries() and 'op5_near_dup' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"}, check=True)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
