"""The driver-facing files keep their contracts."""

import importlib.util
import json
import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_spec = importlib.util.spec_from_file_location("matchup_coverage_script", os.path.join(ROOT, "scripts", "coverage.py"))
cov = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(cov)


def test_every_survey_id_has_a_query():
    covered = set()
    for fn in entry.queries().values():
        covered.update(cov.ids_in((fn.__doc__ or "").split(":", 1)[0]))
    ids = [i for i, _ in cov.survey_ids()]
    assert len(ids) > 100
    assert [i for i in ids if i not in covered] == []


def test_oracles_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bench_prints_one_json_line():
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    env = dict(os.environ, BENCH_SF_DIR=sf, BENCH_ML="0", BENCH_CPUS="2", BENCH_WARMUP_DIR="/nonexistent",
               BENCH_DRIVER_MEMORY="2g")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    doc = json.loads(lines[0])
    assert doc["unit"] == "sec" and doc["sf"] == 0.001 and doc["value"] > 0
    assert set(doc["queries"]) >= {"pit_dual_join", "feature_dataset"}
