"""Queries from a driver whose workers cannot import the package by themselves."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, {root!r})
from corpuscope.session import local_session
from corpuscope.llm.queries import QUERIES
spark = local_session("elsewhere", cores="4")
for name in ("op6_bpe", "op1_warc", "op13_id_shards"):
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_from_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert counts["op6_bpe"] == counts["op13_id_shards"] == "200" and int(counts["op1_warc"]) > 0
