"""Sessions as the library wants them, and shipping the package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "tracewise", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf adds settings, dots as double underscores."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors' Python once, unless they find it on their own path."""
    root = Path(__file__).resolve().parents[1]
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or spark.conf.get("tracewise.shipped", None):
        return
    folder = Path(tempfile.mkdtemp(prefix="tracewise-ship-"))
    shutil.copytree(root / "tracewise", folder / "src" / "tracewise", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / "tracewise"), "zip", folder / "src"))
    shutil.rmtree(folder / "src")
    spark.conf.set("tracewise.shipped", "true")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that driver and executors share, spark.checkpoint.dir. Unset, a local session gets a temp folder; on a cluster that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tracewise.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tracewise-scratch-')}"
        spark.conf.set("tracewise.scratch.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
