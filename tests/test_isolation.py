"""The library without the corpus subpackage, its tests and its pipeline."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as entry
from causaltape.plans import registry

assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())
print(len(entry.queries()))
"""


def test_registry_works_without_the_corpus_folders(tmp_path):
    copy = shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=False)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 160
