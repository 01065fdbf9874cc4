import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_llm_folders(tmp_path, pipeline):
    """A copy of the repository without tempora/llm and tests/llm (and corpus_pipeline.py) imports, registers its queries and collects its tests."""
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "tempora", tmp_path / "tempora", ignore=skip)
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=skip)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k[:2] == 'op' or k == 'pipeline'], set(e.oracle_sql()) <= set(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    n, rest = said.stdout.split(" ", 1)
    assert int(n) > 60 and rest.strip() == "[] True", said.stderr
    tests = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert tests.returncode == 0 and "error" not in tests.stdout, tests.stdout[-500:]
