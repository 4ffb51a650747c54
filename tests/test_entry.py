import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: (-r["score"], r["key"]))


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_corpus_part(tmp_path, pipeline):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    gone = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(root, tmp_path / "rest", ignore=gone)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'score_top_k' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "rest", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_the_rest_works_without_a_library_of_the_corpus_part(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'score_top_k' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op') and n[2].isdigit()]"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
