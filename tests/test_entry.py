"""The entry works without the training-data subpackage, and without a library that it needs."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"


@pytest.mark.parametrize("gone", [("ragloom/llm", "corpus_pipeline.py"), ("ragloom/llm",), ("ragloom/llm/secrets.py",), ()])
def test_entry_without_the_subpackage(tmp_path, gone):
    shutil.copytree(f"{ROOT}/ragloom", tmp_path / "ragloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
            path.mkdir()  # an empty folder is no subpackage either
        elif path.exists():
            path.unlink()
    code = CHECK if gone else "import sys; sys.modules['public_tokenizers'] = None; " + CHECK
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
