"""A folder that driver and executors share, for tables between steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary one, but only on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^-].*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-ledgerlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/ledgerlake/{name}-{uuid.uuid4().hex}"
