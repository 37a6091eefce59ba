"""The entry point imports without a session."""

import os
import subprocess
import sys


def test_import_without_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-500:]
    assert int(said.stdout.split()[-2]) >= 50
