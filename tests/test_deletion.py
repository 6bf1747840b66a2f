"""The rest of the repository works without the training-data operators and their tests."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]
KEPT = ("__spark_entry__.py", "bench.py", "gaugeworks", "tests", "corpus_pipeline.py")


@pytest.mark.parametrize("pipeline", [True, False], ids=["with_pipeline", "without_pipeline"])
def test_entry_without_llm(tmp_path, pipeline):
    for name in KEPT:
        if (TOP / name).is_dir():
            shutil.copytree(TOP / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (TOP / name).exists() and (pipeline or name != "corpus_pipeline.py"):
            shutil.copy(TOP / name, tmp_path / name)
    code = "import __spark_entry__ as e, pkgutil, importlib, tests; q = e.queries(); s = e.oracle_sql(); " + (
        "[importlib.import_module(m.name) for m in pkgutil.iter_modules(tests.__path__, 'tests.') if m.name != 'tests.llm']; "
        "print(len(q), len(s), any(n.startswith('op') or n == 'pipeline' for n in q))"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, with_sql, dealt = out.stdout.split()[-3:]
    assert int(n) > 150 and int(with_sql) > 130 and dealt == "False"
