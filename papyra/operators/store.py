"""Tables written in the folder that all executors share, to cut lineage in iterative operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset and Spark runs in one process (tests).
LOCAL_SHARED = "file:///tmp/checkpoints/papyra-tables"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again; the files go when the session ends."""
    spark: SparkSession = df.sparkSession
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir")
    if not shared:
        if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = LOCAL_SHARED
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)
