"""Operators run where workers have no copy of this package: from another folder, without it on their path."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
CODE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from telvane.session import local_session
spark = local_session("away", "2", 2, spark__checkpoint__dir={shared!r})
for name in {names!r}:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""
NAMES = ["op1_skip_chain_pii_spans", "op3_language_filters_predict", "op11_phrase_stripes_mine", "op12_line_runs_drop", "op13_exact_whitening_project"]


@pytest.mark.parametrize("names", [NAMES])
def test_queries_away_from_the_repository(tmp_path, names):
    code = CODE.format(repo=str(REPO), shared=str(tmp_path / "shared"), names=names)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in got.stdout, got.stderr[-3000:]
