"""Python workers find this package wherever the session was started."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import ROOT

HEAD = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
"""


def run_from(folder, code: str) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", HEAD + code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_files_are_cut_into_records(tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n')
    code = """
from tablecare.sources import manifest, read_csv
print(sorted(tuple(r) for r in read_csv(spark, "a.csv")[0].collect()), manifest(spark, ".").count())
"""
    assert run_from(tmp_path, code).strip() == "[('1', 'x\\ny')] 1"
