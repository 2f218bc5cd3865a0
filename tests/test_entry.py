"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 120


def test_imports_without_the_subpackage(tmp_path):
    """A copy without the optional folder and the pipeline still imports."""
    import shutil

    shutil.copytree(ROOT / "gaugeworks", tmp_path / "gaugeworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 120 and 'pipeline' not in q; e.oracle_sql()"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "gaugeworks").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
