"""bench.py prints exactly one JSON line with the fields the driver records."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    proc = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], cwd=ROOT, env=env,
                          capture_output=True, text=True, timeout=900)
    assert proc.returncode == 0, proc.stderr[-2000:]
    lines = [line for line in proc.stdout.splitlines() if line.strip()]
    assert len(lines) == 1, proc.stdout
    out = json.loads(lines[0])
    assert out["unit"] == "sec" and out["value"] > 0 and out["sf"] == "0.001"
    assert {"e2e_store_fact", "e2e_top_views", "build_total", "serve_top_views"} <= set(out["queries"])
