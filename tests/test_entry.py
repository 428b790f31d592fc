"""The driver contract, with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


def _counted(folder: Path) -> list[str]:
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_every_oracle_has_a_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_the_rest_works_without_the_llm_folders(tmp_path):
    """From a copy: without touchline/llm and tests/llm, with and without corpus_pipeline.py."""
    own = sum(len(plan.QUERIES) for plan in __spark_entry__.PLANS)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path)
    shutil.copytree(REPO / "touchline", tmp_path / "touchline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    assert _counted(tmp_path)[::2] == [str(own), "False"]
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _counted(tmp_path)[::2] == [str(own), "False"]
