"""The driver's contract with and without the training-data subpackage."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDDEN = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if any(name == h or name.startswith(h + ".") for h in {hidden!r}):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if any(name == h or name.startswith(h + ".") for h in {hidden!r}) else real(name, package)
import __spark_entry__ as e
from tidemark import catalog
assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLE_SQL)
"""


@pytest.mark.parametrize("hidden", [["tidemark.llm"], ["tidemark.llm", "corpus_pipeline"]])
def test_entry_without_the_subpackage(hidden):
    done = subprocess.run([sys.executable, "-c", HIDDEN.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_queries_and_their_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
