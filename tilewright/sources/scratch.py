"""A folder for intermediate containers that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; a temporary one in local mode where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tilewright-")
    return f"{base.removeprefix('file://').rstrip('/')}/{uuid.uuid4().hex}"
