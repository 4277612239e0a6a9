"""Session builder with the settings every query of the engine relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()

#: UTC keeps dates equal across engines; AQE re-plans joins and splits skewed partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.ui.retainedExecutions": "20",
    "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "4g"),
}


def session(name: str = "tessera", cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own master and settings."""
    builder = SparkSession.builder.appName(name).master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)} | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers, once an application, where their path may not have it."""
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if _ROOT in paths or Path.cwd().resolve() == _ROOT or app in _SHIPPED:
        return spark
    archive = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((_ROOT / "tessera").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
    return spark


def table(spark: SparkSession, folder: str, name: str):
    """One parquet table of a data folder; Spark's own readers open every path."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
