"""The driver's functions without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_queries_without_the_optional_subpackage(tmp_path, with_pipeline):
    shutil.copytree(f"{ROOT}/palimpsest", tmp_path / "palimpsest", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py") else [])]:
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 140 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
