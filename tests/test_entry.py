import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n == 'pipeline' or n.startswith('op')))"


@pytest.mark.parametrize("gone", [("parley/llm", "tests/llm"), ("parley/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    """The engine's queries load in a copy that has lost the corpus operators, with or without their pipeline's file."""
    for name in ("parley", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    for name in gone:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        else:
            (tmp_path / name).unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, oracles, names = out.stdout.split(maxsplit=2)
    assert int(queries) >= 50 and int(oracles) >= 40 and names.strip() == "[]"
