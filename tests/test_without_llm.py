"""The entry module where the folder of the training-data operators, or the pipeline, is gone or can't be imported."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') and k[2:3].isdigit() for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("broken", [False, True])
def test_entry(tmp_path, broken):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tidewell", tmp_path / "tidewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if broken:
        (tmp_path / "tidewell" / "llm").mkdir()
        (tmp_path / "tidewell" / "llm" / "catalog.py").write_text("import no_such_module_at_all\n")
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 70 and out[1:] == ["0", "False", "True"]
