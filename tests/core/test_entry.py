"""The entry file without the training-data operators, or a module that only they use."""

import subprocess
import sys

import pytest


@pytest.mark.parametrize("gone", ["xxhash", "tidewater.llm", "corpus_pipeline"])
def test_core_queries_without(gone):
    code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.oracle_sql()), 'ledger_mixed' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=sys.path[0])
    n, own, mixed = out.stdout.split()
    assert int(n) > 80 and own == "0" and mixed == "True"
