import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_the_entry_stands_without_the_training_data_package(tmp_path):
    """In a copy without the package, with and without the pipeline file, the core queries still register."""
    for name in ("docsieve", "catalog"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = ("import __spark_entry__ as e; q = e.queries(); assert 'classify_best' in q and set(e.oracle_sql()) <= set(q); "
            "assert not [n for n in q if n.startswith('op') or n == 'pipeline']")
    for extra in (False, True):
        if extra:
            shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
