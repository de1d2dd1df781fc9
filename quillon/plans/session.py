"""Session set-up that queries share."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it; on a cluster it is installed there or shipped by --py-files."""
    home = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{home}:{known}".rstrip(":")
    # Arrow batches are bounded by bytes as well as by rows, as texts have any length; a bound that is set stays
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, str(8 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
