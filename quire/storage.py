"""Tables in the cluster's shared folder: cuts in the lineage that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master that names none."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d is None:
        set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = set_by_hand.get() if set_by_hand.isDefined() else None
    if d is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
