"""The entry point loads before there is a Spark session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_no_session_needed():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 50)"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == "True", said.stderr
