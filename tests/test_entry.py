"""The driver's entry module, with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("without", [(), ("corpus_pipeline.py",), ("colloquy/llm", "tests/llm"), ("colloquy/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_optional_parts(tmp_path, without):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in without:
        path = to / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=to, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True).stdout
    queries, oracle = (set(x.split()) for x in out.splitlines())
    assert len(queries) > 100 and oracle <= queries
    if "colloquy/llm" in without:
        assert not any(q.startswith("op") and q[2].isdigit() for q in queries) and "pipeline" not in queries
