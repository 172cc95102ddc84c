"""The library without the operators of plantwave.llm, whether the pipeline's file stays or goes."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *gone))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import __spark_entry__ as e; names = set(e.queries()); assert names and names >= set(e.oracle_sql()) and 'pipeline' not in names and not [n for n in names if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)
