"""The rest of the repository does without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_entry_imports_without_it(tmp_path, left):
    copy = tmp_path / "repo"
    gone = {"llm", "corpus_pipeline.py"} - set(left)
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", *gone, "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'revenue_monthly' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy), "HOME": str(tmp_path)}, check=True, timeout=120)


def test_nothing_else_imports_it():
    for p in (ROOT / "tarnmill").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tarnmill.llm" not in p.read_text(), p
