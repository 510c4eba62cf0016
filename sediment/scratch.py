"""A fresh folder that all executors share, for files that a query writes and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """In spark.checkpoint.dir; in a temporary folder only for local masters without it."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="sediment-")
        _OWN[sc.applicationId] = root
    root = root if "://" in root else f"file://{os.path.abspath(root)}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}/{name}"
