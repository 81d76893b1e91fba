"""The entry without the optional subpackage, or without a library that only it needs."""
import os
import subprocess
import sys

import pytest

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("absent", ["tillroll.llm", "corpus_pipeline", "xxhash", "tokenizers"])
def test_entry_imports_without(absent):
    code = f"import sys; sys.path.insert(0, {HOME!r}); sys.modules[{absent!r}] = None\nimport __spark_entry__ as E\nq = E.queries()\nassert 'rfm' in q and set(E.oracle_sql()) <= set(q)\nprint(len(q))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and int(out.stdout) > 60, out.stderr[-1500:]
