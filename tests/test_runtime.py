"""The folder shared with executors, and shipping the package."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from lumenfold import runtime


def session(named, master="local[2]"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named), sparkContext=SimpleNamespace(master=master, applicationId="a1"))


def test_shared_dir():
    assert runtime.shared_dir(session("hdfs://n/c/")) == "hdfs://n/c"
    own = runtime.shared_dir(session(None))
    assert Path(own).is_dir() and runtime.shared_dir(session("")) == own
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            runtime.shared_dir(session(None, master))


def test_executors_can_import_the_package(tmp_path):
    """From another folder, with the package on the driver's path alone and no shared folder set."""
    root = Path(runtime.__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from lumenfold.sources.media import image_stats
print("ROWS", image_stats(spark.sql("SELECT X'89504E470D0A1A0A0000000D4948445200000280000001E0' AS content")).first().width)
"""
    (tmp_path / "conf").mkdir()
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(tmp_path / "conf")}, capture_output=True, text=True, timeout=180)
    assert "ROWS 640" in done.stdout, done.stderr[-2000:]
