"""The package reaches workers of a session that was started elsewhere."""

import hashlib
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from veerline.deploy import ship
from veerline.functions.canonical import json_hash
ship(s); ship(s)
print("GOT", s.sql("SELECT '[1, 2]' AS x").select(json_hash("x")).first()[0])
"""


def test_workers_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200, check=False)
    assert f"GOT {hashlib.sha256(b'[1, 2]').hexdigest()[:12]}" in out.stdout, out.stderr[-2000:]
