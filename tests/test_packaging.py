"""The library works with the driver started anywhere, without PYTHONPATH."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import ROOT, SF001

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from mktpulse.session import build_session, ship_package
spark = build_session("local[2]", 2)
ship_package(spark)

def versions(batches):
    import pandas as pd
    from mktpulse.contracts import NA_TOKENS  # in a worker, from the shipped package
    for b in batches:
        yield pd.DataFrame({{"n": [len(NA_TOKENS)]}})

print("tokens", spark.range(1).mapInPandas(versions, "n long").first().n)
import __spark_entry__ as se
print("pairs", se.queries()["attribution_models"](spark, {SF001!r}).count())
"""


def test_other_working_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
    assert "tokens 19" in got.stdout and "pairs " in got.stdout
