"""Arrow batches bounded by bytes, for functions whose rows are wide."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch handed to Python.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Python gets batches bounded by bytes, so that wide rows don't pile up in one of many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
