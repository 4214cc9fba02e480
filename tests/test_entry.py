"""The entry without the corpus folders: what is left imports and keeps its queries."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_corpus_folders(tmp_path, pipeline):
    shutil.copytree(ROOT / "steadycast", tmp_path / "steadycast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) - set(q), [k for k in q if k.startswith('op')])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    number, *rest = done.stdout.split()
    assert int(number) > 150 and rest == ["set()", "[]"]
