"""Session settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Adaptive execution with skew handling, dynamic pruning and UTC times.

    Nothing here depends on the size of the cluster: shuffle partitions start high and are
    coalesced at run time, skewed join partitions are split, and broadcast joins follow measured
    sizes.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder of the cluster, for tables that outlive a stage.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session without that
    setting falls back to a temporary folder of the machine, which is then also the whole cluster.
    """
    import re
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="kinfold-")
    return f"{base.rstrip('/')}/kinfold-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` in the shared folder and read back, which cuts its lineage."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
