"""The driver's entry loads with and without what the language-model queries need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError("No module named " + name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
from wiretally.registry import QUERIES
q = e.queries()
assert set(QUERIES) <= set(q), "a core query is gone"
print(len(q) - len(QUERIES))
"""


@pytest.mark.parametrize("name", ["wiretally.llm", "zstandard", "corpus_pipeline"])
def test_core_queries_do_not_need(name):
    out = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert "left out" in out.stderr and name.split(".")[-1] in out.stderr
    if name != "corpus_pipeline":
        assert out.stdout.strip() == "0"
