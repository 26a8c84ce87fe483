"""The engine without its training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_training_data_operators(tmp_path, also):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *also))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q) and not any(k.startswith('op1_') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
