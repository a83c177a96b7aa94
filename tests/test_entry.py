"""The entry without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("without_pipeline", [False, True])
def test_entry_works_without_the_text_operators(tmp_path, without_pipeline):
    left_out = ["llm", ".git", "__pycache__", *(["corpus_pipeline.py"] if without_pipeline else [])]
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(*left_out))
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op1') for q in e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    n, pipeline, text_operators = found.stdout.split()
    assert int(n) > 100 and pipeline == "False" and text_operators == "False"
