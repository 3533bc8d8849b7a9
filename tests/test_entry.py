"""The entry module without the text operators, or without a library that they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Blocked())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()), "mart_sales_by_time" in entry.queries(), "pipeline" in entry.queries())
"""


@pytest.mark.parametrize("name", ["martloom.llm", "corpus_pipeline", "xxhash", "sentencepiece", "zstandard"])
def test_a_blocked_module_costs_no_query_of_the_engine(name):
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", SCRIPT.format(name=name, root=str(ROOT))], capture_output=True, text=True, timeout=60)
    count, sql, mart, pipeline = done.stdout.split()
    assert int(count) >= 50 and int(sql) >= 50 and mart == "True", done.stderr
    if name not in ("sentencepiece",):  # that one is imported by the tasks that need it
        assert pipeline == "False"
