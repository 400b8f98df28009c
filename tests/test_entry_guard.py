"""The entry module works without the text subpackage or the pipeline file."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", [["driftwood.llm"], ["corpus_pipeline"], ["driftwood.llm", "corpus_pipeline"],
                                     ["regex"], ["xxhash"]])
def test_entry_without_text_queries(missing):
    code = (f"import sys; sys.modules.update(dict.fromkeys({missing!r})); import __spark_entry__ as E; "
            "q = E.queries(); assert len(q) >= 84 and 'pipeline' not in q, sorted(q); "
            "assert not [n for n in q if n.startswith('op')], q; assert set(E.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=120)
