"""Tables written once and read back from the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def new_path(spark, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or where that is unset and Spark is one process, under a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tallywise-"))
    return f"{root.rstrip('/')}/tallywise/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df under spark.checkpoint.dir (where unset, a temporary folder) and reads it: for results used repeatedly."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
