"""Executors must not need the package installed: a driver started elsewhere, with the
repository only on its own sys.path, scores through mapInArrow."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
from quakeframe.operators.scoring import AttenuationScorer, score
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
rows = [(1, [[[0.0, 1.5, 0.0]] * 4], [[24.0, 121.0, 0.1, 300.0]], [(0, 24.0, 121.0, 0.1, 300.0)])]
df = spark.createDataFrame(rows, "k long, waveform array<array<array<float>>>, station array<array<double>>, "
                                 "targets array<struct<slot:int, lat:double, lon:double, elev:double, vs30:double>>")
print("ROWS", score(df, [AttenuationScorer(0.5, 0.3, "a")], ["k"]).count())
"""


def test_scoring_from_foreign_cwd():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tempfile.gettempdir(), env=env,
                         capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]
