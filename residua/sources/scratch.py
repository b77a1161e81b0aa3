"""A folder of its own for what a query writes on the way, where all executors see it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """Below spark.checkpoint.dir; a temporary folder serves only where none is set. It goes
    when Python ends."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="residua-")
        sc.setCheckpointDir(root)
    path = f"{root}/residua-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone, and the folder with it or left to its owner
            return

    atexit.register(clean)
    return path
