"""The driver contract without the optional subpackage: its queries go, all others stay."""

import os
import shutil
import subprocess
import sys

import pytest

import seqlake.plans as plans

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *[q for q in e.queries() if q[:2] == 'op' or q == 'pipeline'])"


def ask(folder, before=""):
    run = subprocess.run([sys.executable, "-c", before + ASK], cwd=folder, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": folder}, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


@pytest.mark.parametrize("how", ["deleted", "empty", "library"])
def test_other_queries_stay(tmp_path, how):
    copy = f"{tmp_path}/repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "spark-warehouse"))
    before = ""
    if how == "library":
        before = "import sys; sys.modules['sentencepiece'] = None; "
    else:
        # "empty": the folder is left, as a clean-up may leave it, but its modules are gone
        shutil.rmtree(f"{copy}/seqlake/llm", ignore_errors=True)
        if how == "empty":
            os.makedirs(f"{copy}/seqlake/llm/__pycache__")
        elif os.path.exists(f"{copy}/corpus_pipeline.py"):
            os.remove(f"{copy}/corpus_pipeline.py")
    # without sentencepiece, or without any file of it, nothing of the subpackage can be imported
    assert ask(copy, before) == [str(len(plans.queries())), str(len(plans.oracle_sql()))]
