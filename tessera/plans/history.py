"""Registered queries over time and ranges, and statistics of several levels: the version valid at an event, chunks that edits touch, runs of events, cubes, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import stats
from ..operators.temporal import overlapping, valid_at
from ..sources import scratch
from ..streaming.quiet import PROVIDER, quiet
from .catalog import _CHUNKS, _FILES, _is_folder, chunks, files, query, table


@query("""
WITH v AS (
  SELECT * FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY client_id, valid_at ORDER BY segment DESC NULLS LAST, city DESC NULLS LAST, change_id DESC) = 1)
SELECT c.click_id, c.ts, v.segment, v.city, v.valid_at AS valid_from
FROM clicks c ASOF LEFT JOIN v ON c.client_id = v.client_id AND c.ts >= v.valid_at""")
def version_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the segment and city that its client had then."""
    clicks = table(spark, sf_dir, "clicks").select("click_id", "client_id", "ts")
    changes = table(spark, sf_dir, "client_changes").select("client_id", "valid_at", "segment", "city")
    return valid_at(clicks, changes, "client_id", "ts", ["segment", "city"], "valid_at").select("click_id", "ts", "segment", "city", "valid_from")


_EDITS = f"(SELECT filePath, k AS startLine, k + length(line) % 5 AS endLine FROM (SELECT filePath, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT filePath, string_split(text, chr(10)) AS ls FROM {_FILES})) WHERE length(line) % 7 = 3)"


@query(f"SELECT c.id, e.startLine AS first, e.endLine AS last FROM {_CHUNKS} c JOIN {_EDITS} e ON c.filePath = e.filePath AND c.startLine <= e.endLine AND e.startLine <= c.endLine")
def chunks_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with each range of edited lines that touches it; an edit stands for a line of a certain length and some after it."""
    line = F.posexplode(F.split("text", "\n")).alias("k", "line")
    edits = files(spark, sf_dir).select("filePath", line).where(F.length("line") % 7 == 3)
    edits = edits.select("filePath", (F.col("k") + 1).alias("startLine"), (F.col("k") + 1 + F.length("line") % 5).alias("endLine"))
    found = overlapping(chunks(spark, sf_dir).select("id", "filePath", "startLine", "endLine"), edits, "filePath", "startLine", "endLine", 50)
    return found.select("left.id", F.col("right.startLine").cast("long").alias("first"), F.col("right.endLine").cast("long").alias("last"))


_CHUNK_TOKENS = f"(SELECT filePath, hash, lang, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, CASE WHEN startLine = 1 THEN 'definition' ELSE 'implementation' END AS role FROM {_CHUNKS})"


def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("startLine") == 1, "definition").otherwise("implementation")
    return chunks(spark, sf_dir).select("filePath", "hash", "lang", token_estimate(F.col("content"), exact=True).alias("tokens"), role.alias("role"))


@query(f"SELECT lang, role, CAST(grouping_id(lang, role) AS BIGINT) AS level, count(DISTINCT filePath) AS files, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM {_CHUNK_TOKENS} GROUP BY CUBE (lang, role)")
def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, chunks and tokens by language and role, by either, and of all."""
    return stats.rollup(chunk_tokens(spark, sf_dir), ["lang", "role"])


_NEAR = 0.06


@query(f"SELECT lang, count(*) AS chunks, true AS files_near, true AS hashes_near, true AS median_near FROM {_CHUNK_TOKENS} GROUP BY lang")
def stats_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of two versions (by role), merged by language: whether they tell what exact counts and ranks do, within their error."""
    rows = chunk_tokens(spark, sf_dir)
    told = stats.estimates(stats.merged_sketches(stats.sketches(rows, ["lang", "role"]), ["lang"]), ["lang"])
    true = rows.groupBy("lang").agg(F.countDistinct("filePath").alias("f"), F.countDistinct("hash").alias("h"))
    below = rows.join(told.select("lang", "q50"), "lang").groupBy("lang").agg((F.avg(F.when(F.col("tokens") < F.col("q50"), 1.0).otherwise(0.0))).alias("less"), F.avg(F.when(F.col("tokens") <= F.col("q50"), 1.0).otherwise(0.0)).alias("most"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= _NEAR * F.col(b)
    return told.join(true, "lang").join(below, "lang").select("lang", "chunks", near("files", "f").alias("files_near"), near("hashes", "h").alias("hashes_near"), ((F.col("less") <= 0.5 + _NEAR) & (F.col("most") >= 0.5 - _NEAR)).alias("median_near"))


_QUIET_S, _LATE_S = 1800, 600


@query(f"""
WITH timed AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
marked AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {_QUIET_S} * 1000000 THEN 0 ELSE 1 END AS opens FROM timed),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS run FROM marked)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM numbered GROUP BY user_id, run
HAVING ceil((max(us) + {_QUIET_S} * 1000000) / 1000.0) <= (SELECT floor(max(us) / 1000.0) - {_LATE_S} * 1000 FROM timed)""")
def watch_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream with state: the runs that are over by the last watermark."""
    events, at = table(spark, sf_dir, "events"), scratch.folder(spark)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") if dict(events.dtypes)["ts"] == "timestamp_ntz" else F.unix_micros("ts")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet") if _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        told = quiet(stream.select(F.col("user_id").cast("string").alias("user"), F.timestamp_micros(micros).alias("ts")), "user", gap_s=_QUIET_S, late=f"{_LATE_S} seconds")
        running = told.writeStream.format("parquet").option("path", f"{at}/runs").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    runs = spark.read.schema("key string, start timestamp, end timestamp, n long").parquet(f"{at}/runs")
    return runs.select(F.col("key").cast("long").alias("user_id"), F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
