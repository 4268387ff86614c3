"""The driver's contract."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_are_listed_without_a_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 100, out.stderr[-500:]


def test_nothing_else_imports_the_training_data_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/riskflow"):
        if not folder.endswith("llm"):
            assert not any(".llm" in open(f"{folder}/{n}").read() for n in names if n.endswith(".py")), folder
