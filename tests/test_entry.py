"""The store's queries stay where the training-data operators can't be imported."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_an_importable_subpackage():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(o) <= set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
