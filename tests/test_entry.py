"""The driver's contract, with and without the training-data part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_oracles_have_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["query_id", "doc_id", "score", "rank"] and out.count() > 0


def test_imports_without_training_data_part(tmp_path):
    shutil.copytree(ROOT / "scriptorium", tmp_path / "scriptorium", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    show = "import __spark_entry__ as e; print(len(e.queries()), sum(k[:2] == 'op' or k == 'pipeline' for k in e.queries()))"

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}

    def run():
        done = subprocess.run([sys.executable, "-B", "-c", show], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
        return tuple(map(int, done.stdout.split()[-2:]))

    n, llm = run()  # no corpus_pipeline.py
    assert llm in (0, 10)  # 0: the part was absent before
    core = n - llm
    assert core > 100
    shutil.rmtree(tmp_path / "scriptorium/llm", ignore_errors=True)
    assert run() == (core, 0)
    (tmp_path / "scriptorium/llm").mkdir()  # an emptied folder
    assert run() == (core, 0)
    (tmp_path / "corpus_pipeline.py").write_text("from scriptorium.llm import exact_dedup\n")  # left alone
    assert run() == (core, 0)
