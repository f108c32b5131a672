"""The entry point without the optional corpus part."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("library", ["ahocorasick", "xxhash", "basketry.llm", "corpus_pipeline"])
def test_missing_corpus_library_leaves_the_others(library):
    code = f"import sys; sys.modules[{library!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, sql, corpus = done.stdout.split()
    assert int(n) > 120 and int(sql) > 100
    assert corpus == "False"
