"""Shared scratch space for checkpoints and tables a job writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``.  A session that names none gets a temporary
    folder if its master is local; on a cluster that is an error, for executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="memlake-")
    return f"{base.rstrip('/')}/memlake/{name}-{uuid.uuid4().hex}"
