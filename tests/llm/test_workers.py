"""The tasks of the operators run where the package is not installed."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})  # the driver's path only
from kinfold.llm import catalog
from kinfold.session import local_session
spark = local_session(4, 4, "2g")
for name in ("op1_longest_match_counts", "op4_gru_language", "op7_nce_lm_score", "op13_chunk_memo_fim"):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200, name
print("all done")
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert run.returncode == 0 and "all done" in run.stdout, run.stderr[-3000:]
