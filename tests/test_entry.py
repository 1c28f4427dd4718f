"""The driver contract holds where the corpus subpackage, its tests and the pipeline's module are not there, in any mixture."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import re, __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'presence_grid' in q; print(sorted(n for n in q if n == 'pipeline' or re.match('op[0-9]+_', n)))"


@pytest.mark.parametrize("gone", [("matchlake/llm", "tests/llm"), ("matchlake/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_corpus_subpackage(tmp_path, gone):
    shutil.copytree(HERE, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *(os.path.basename(g) for g in gone)))
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == "[]"


def test_queries_and_sql_agree():
    sys.path.insert(0, HERE)
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
