"""Tables in the folder that driver and executors share, for cutting lineage and for what is used twice."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one is set only where none is and driver and executors are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="ledgerlane-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lost executor costs only the tasks since then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlane/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
