from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_lives_without_the_corpus_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[-1] in {blocked!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "pipeline" not in e.queries() and not any(q.startswith("op") and q[2].isdigit() for q in [*e.queries(), *e.oracle_sql()])
assert "node_report" in e.queries()
"""
    for blocked in (("llm", "corpus_pipeline"), ("xxhash",), ("public_tokenizers",)):
        subprocess.run([sys.executable, "-c", code.replace("{blocked!r}", repr(blocked))], check=True, cwd=Path(entry.__file__).parent, timeout=120)
