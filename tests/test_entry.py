"""The registry holds together, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(__file__).resolve().parent.parent


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"lang", "chunks", "chars", "longest"}


def test_without_the_corpus_operators(tmp_path):
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    shutil.copytree(HERE / "docprep", tmp_path / "docprep", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; names = set(e.queries()); assert names and not any(n.startswith('op') or n == 'pipeline' for n in names); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
