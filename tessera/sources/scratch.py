"""Where a query keeps what it writes on the way: below spark.checkpoint.dir, which all of a cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tessera-shared-")


def folder(spark: SparkSession) -> str:
    """A new folder of that kind."""
    return f"{_shared(spark).rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written once, so that lost executors don't cost what led to them."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)
