"""Python workers get the package from the session, wherever the driver was started."""

import os
import subprocess
import sys

from .conftest import ROOT

CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pluvia import catalog
from pluvia.operators import features, trend
from pluvia.session import session
spark = session("local[2]", 2, **{{"spark.ui.enabled": "false"}})
root = sys.argv[1]
wet = spark.createDataFrame([("S", 0, r, 0.0, r / 10 + 0.05) for r in (0, 1, 5)], "SID string, TIME int, ROW int, LON double, DLON double")
print("regions", features.labelled(wet).select("FEATURE").distinct().count())
print("cells", catalog.QUERIES["attributed_cells"](spark, root).count() > 0)
print("daily", trend.trends(spark.range(900).selectExpr("'k' AS k", "id AS YEAR", "id * 1.0 AS y"), ["k"], "y", per=1.0).first()["slope"])
print("footers", catalog.QUERIES["source_footers"](spark, root).count() > 0 if "source_footers" in catalog.QUERIES else True)
"""


def test_from_another_folder(data, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, f"{data}/sf0.001"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split("\n")[:4] == ["regions 2", "cells True", "daily 1.0", "footers True"]
