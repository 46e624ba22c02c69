"""What a session needs: this package on the executors, a folder that all share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Once per context, through Spark's own file server, so that Python functions load
    wherever the executors run."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_mnemolake_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="mnemolake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = Path(folder) / "mnemolake-package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    spark.sparkContext.addPyFile(str(to))
    spark.sparkContext._mnemolake_shipped = True  # type: ignore[attr-defined]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a temporary one in local mode,
    and an error elsewhere: executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="mnemolake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
