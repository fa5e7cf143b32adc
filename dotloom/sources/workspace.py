"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only a local session without it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="dotloom-"))
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
