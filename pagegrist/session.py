"""Session defaults, and shipping of this package to the Python workers of a running session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_HERE = Path(__file__).resolve().parent


def session(app: str = "pagegrist", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume; cluster settings are left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Bytes of an Arrow batch that goes to a Python worker, where the session doesn't say: long texts don't come by thousands.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, also where it isn't installed; once per Spark context. Bounds Arrow batches by bytes."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_pagegrist_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{_HERE.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_HERE.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(_HERE.parent))
    sc.addPyFile(path)
    sc._pagegrist_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where their scan has fewer partitions than there are cores.

    For work that costs far more than a shuffle of its input. Only tables of a few files or row groups are dealt anew; a large table has
    more partitions than cores and is read as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
