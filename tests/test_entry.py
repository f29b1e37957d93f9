"""The entry module without the training-data operators, and without a library that only they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

BLOCK = """
import sys, warnings
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {gone!r}:
            raise ModuleNotFoundError(f"No module named {{name}}", name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {root!r})
warnings.simplefilter("ignore")
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 90 and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names, sorted(names)
assert set(e.oracle_sql()) <= names
"""


@pytest.mark.parametrize("gone", [("pagegrist.llm",), ("corpus_pipeline",), ("xxhash",)])
def test_without(gone):
    assert subprocess.run([sys.executable, "-c", BLOCK.format(gone=gone, root=str(ROOT))], cwd=ROOT).returncode == 0


def test_faults_of_the_engine_show():
    code = BLOCK.format(gone=("pagegrist.plans.registry",), root=str(ROOT))
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode != 0
