import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), e.llm is None)"


def _copy(to: Path) -> Path:
    shutil.copytree(ROOT / "vigilake", to / "vigilake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", to)
    return to


def _run(folder: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120)


def test_without_the_corpus_operators(tmp_path):
    out = _run(_copy(tmp_path)).stdout.split()
    assert int(out[0]) == int(out[1]) > 80 and out[2] == "True"


def test_any_other_missing_module_is_an_error(tmp_path):
    (_copy(tmp_path) / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    got = _run(tmp_path)
    assert got.returncode and "a_module_that_is_not_there" in got.stderr


@pytest.mark.skipif(not (ROOT / "vigilake" / "llm").exists(), reason="the corpus operators are left out")
def test_with_them():
    out = _run(ROOT).stdout.split()
    assert int(out[0]) > int(out[1]) and out[2] == "False"
