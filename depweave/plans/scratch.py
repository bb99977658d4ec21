"""Tables that cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder of spark.checkpoint.dir and reads it again, so that a lost executor
    costs no iteration. Only where the setting is absent (tests, one machine) a temporary folder is used."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        top = tempfile.mkdtemp(prefix="depweave-")
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
