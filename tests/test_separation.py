"""The rest of the library without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
TRY = """
import __spark_entry__ as entry
names = set(entry.queries())
assert "violations_per_frame" in names and "pipeline" not in names, names
assert not [n for n in names if n.startswith("op")]
assert set(entry.oracle_sql()) <= names
"""


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_without_corpus_operators(tmp_path, pipeline_too):
    skip = shutil.ignore_patterns("__pycache__", "llm")
    shutil.copytree(ROOT / "waymesh", tmp_path / "waymesh", ignore=skip)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if not pipeline_too and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    subprocess.run([sys.executable, "-c", TRY], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_them():
    for path in (ROOT / "waymesh").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
