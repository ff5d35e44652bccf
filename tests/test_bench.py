"""bench.py prints the one JSON line the driver records."""

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SF0001


def test_bench_prints_one_json_line():
    env = {**os.environ, "BENCH_SF_DIR": SF0001, "BENCH_CPUS": "2"}
    proc = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "late_ratio_created",
                           "factor_payback_country"], capture_output=True, text=True, env=env,
                          timeout=600, cwd=ROOT)
    assert proc.returncode == 0, proc.stderr[-2000:]
    lines = [l for l in proc.stdout.splitlines() if l.strip()]
    assert len(lines) == 1
    out = json.loads(lines[0])
    assert out["unit"] == "sec" and out["sf"] == 0.001
    assert set(out["queries"]) == {"late_ratio_created", "factor_payback_country"}
    assert abs(out["value"] - sum(out["queries"].values())) < 1e-6
    assert out["reference_value"] == out["value"] and out["training_value"] == 0
