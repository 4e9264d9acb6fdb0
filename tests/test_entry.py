"""What the entry lists when parts are missing."""

import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parents[1]
ASK = """
import importlib.abc, sys
class Missing(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
q = e.queries()
print("LISTED", len(q), "pipeline" in q, any(n.startswith("op1_") for n in q), set(e.oracle_sql()) <= set(q))
"""


@pytest.mark.parametrize(
    ("missing", "listed", "warns"),
    [("nothing", "True True True", False), ("zstandard", "False False True", True), ("public_tokenizers", "False False True", True), ("gridfolio.llm", "False False True", False), ("corpus_pipeline", "False True True", False)],
)
def test_missing_modules_leave_out_their_part(missing, listed, warns):
    pytest.importorskip("gridfolio.llm", reason="the subpackage isn't there")
    ran = subprocess.run([sys.executable, "-c", ASK.format(missing=missing)], cwd=HERE, capture_output=True, text=True, timeout=300)
    told = next((line for line in ran.stdout.splitlines() if line.startswith("LISTED")), ran.stderr)
    assert told.split(" ", 2)[2] == listed and int(told.split()[1]) > 100
    assert ("is left out" in ran.stderr) == warns


def test_own_faults_are_errors():
    pytest.importorskip("gridfolio.llm", reason="the subpackage isn't there")
    ran = subprocess.run([sys.executable, "-c", ASK.format(missing="gridfolio.session")], cwd=HERE, capture_output=True, text=True, timeout=300)
    assert ran.returncode and "gridfolio.session" in ran.stderr
