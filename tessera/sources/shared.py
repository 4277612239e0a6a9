"""Tables written to storage that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, under a local one, on one machine only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = _LOCAL.get("top") or _LOCAL.setdefault("top", tempfile.mkdtemp(prefix="tessera-"))
    return f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
