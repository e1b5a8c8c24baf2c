"""Session defaults for large inputs; each can be overridden by the caller's own settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "loomgraph", master: str | None = None, **settings: str) -> SparkSession:
    """A session with DEFAULTS and settings (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where it lies; on a cluster it is installed or sent with --py-files."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_base(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; where that is unset, below a folder of this machine, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/loomgraph-shared"
    return f"{base.rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}"


def step_folder(spark: SparkSession) -> str:
    """A new folder for the steps of one operator."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, at: str) -> DataFrame:
    """Write a step below the shared checkpoint folder, so that lineage stays short and survives lost executors."""
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
