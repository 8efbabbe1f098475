"""The driver's entry with and without the folder of text operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("cashtrail.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
"""


def names(prefix=""):
    code = prefix + f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True)
    return [set(line.split()) for line in done.stdout.strip().splitlines()]


def test_the_rest_imports_without_text_operators():
    queries, oracles = names(BLOCK)
    assert len(queries) > 150 and oracles <= queries and not any(q.startswith("op") and q[2].isdigit() for q in queries) and "pipeline" not in queries
