"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names_in(home: Path) -> list[str]:
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=home, env=os.environ | {"PYTHONPATH": str(home)}, capture_output=True, text=True, check=True)
    return done.stdout.split()


def test_entry_with_everything(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_entry_survives_without_the_subpackage(tmp_path):
    home = tmp_path / "repo"
    shutil.copytree(ROOT, home, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    left = names_in(home)
    assert len(left) > 100 and not any(x.startswith("op1_") or x == "pipeline" for x in left)
    if (ROOT / "plumbline" / "llm").is_dir():
        assert "op1_embedding_near_dedup" in names_in(ROOT)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "plumbline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "plumbline.llm" not in path.read_text(), path
