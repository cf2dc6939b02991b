import importlib
import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parents[1]


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    code = (
        "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(q[:2] == 'op' and q[2].isdigit() for q in e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for p in ROOT.joinpath("tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) tidemark\.llm|import llm", p.read_text(), re.M), p
    importlib.import_module("tidemark.plans.catalogue")
