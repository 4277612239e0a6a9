"""What several operators of this package need: shared storage and words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than the space and U+0009 to U+000D.
SPACE_CLASS = r"[ \x09-\x0D]+"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name under the folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) a local temporary folder takes its place.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = getattr(shared_folder, "local", None) or tempfile.mkdtemp(prefix="tessera-")
        shared_folder.local = top
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    This cuts lineage: a lost executor costs at most the running stage.
    """
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, usable inside further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
