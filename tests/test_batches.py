from pyspark.sql import functions as F

from tessera.operators.embedding import batch_totals


def test_batches_are_full_whatever_the_ranges(spark):
    """Ranges that adaptive execution joins by their bytes are the same for the counts and for the rows."""
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 30_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.repeat(F.lit("x"), (F.col("id") % 997).cast("int")).alias("embedText")).dropDuplicates(["id"])
        have = {r.batch: (r.texts, r.tokens) for r in batch_totals(rows, 100).collect()}
        tokens = [-(-len(r.embedText) // 4) for r in rows.orderBy("id").collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert have == {k: (100, sum(tokens[100 * k : 100 * k + 100])) for k in range(300)}
