"""The folder all executors can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset, as in a local test, a temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="annospark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
