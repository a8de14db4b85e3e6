"""Queries of job progress."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.plans.registry import Registry
from codelode.session import cut, shared_dir
from codelode.sources.store import Store
from codelode.sources.tables import table
from codelode.streaming import progress as P

R = Registry()
ONCE = "(SELECT DISTINCT ON (job_id, event, ts) * FROM progress WHERE job_id IS NOT NULL AND event IS NOT NULL AND ts IS NOT NULL)"
STAGE = "CASE WHEN regexp_matches(event, '^(phase|agent):[^:]+:(start|complete)$') THEN split_part(event, ':', 2) END"


@R.add(f"SELECT job_id, event, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM {ONCE} GROUP BY job_id, event")
def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    """STR2: events of each job without repeats."""
    once = P.deduplicated(table(spark, d, "progress"))
    us = lambda c: F.expr(f"unix_micros(cast({c}(ts) as timestamp))")
    return once.groupBy("job_id", "event").agg(F.count("*").alias("n"), us("min").alias("first_us"), us("max").alias("last_us"))


STATE_SQL = f"""
WITH g AS (SELECT job_id, arg_max({STAGE}, ts) FILTER (ends_with(event, ':start')) AS begun, max(ts) FILTER (ends_with(event, ':start')) AS begun_at, max(ts) FILTER (ends_with(event, ':complete')) AS done_at,
  coalesce(string_agg(DISTINCT CASE WHEN ends_with(event, ':complete') THEN {STAGE} END, ' ' ORDER BY CASE WHEN ends_with(event, ':complete') THEN {STAGE} END), '') AS completed, count(*) AS events,
  bool_or(event IN ('stream:end', 'job:cleanup:complete', 'error', 'job:error')) AS finished, bool_or(event IN ('error', 'job:error')) AS failed, max(ts) AS last_ts FROM {ONCE} GROUP BY job_id)
SELECT job_id, CASE WHEN done_at IS NULL OR done_at < begun_at THEN begun END AS active, completed, events, finished, failed, epoch_us(last_ts) AS last_us FROM g
"""


@R.add(STATE_SQL)
def latest_job_state(spark: SparkSession, d: str) -> DataFrame:
    """STR3-4: where every job stands."""
    return P.latest_state(table(spark, d, "progress")).withColumn("last_us", F.expr("unix_micros(cast(last_ts as timestamp))")).drop("last_ts")


@R.add(f"SELECT job_id, epoch(date_trunc('minute', ts))::BIGINT AS minute, count(*) AS n FROM {ONCE} GROUP BY 1, 2")
def events_by_minute(spark: SparkSession, d: str) -> DataFrame:
    """Events of each job by minute of event time."""
    return P.windowed_counts(table(spark, d, "progress")).select("job_id", F.expr("unix_timestamp(cast(begins as timestamp))").alias("minute"), "n")


@R.add("""
WITH m AS (SELECT job_id, max(received_at) AS now FROM progress GROUP BY job_id)
SELECT p.job_id, count(*) AS n FROM progress p JOIN m ON p.job_id = m.job_id WHERE received_at > now - INTERVAL 5 SECOND GROUP BY 1
""")
def replay_buffer(spark: SparkSession, d: str) -> DataFrame:
    """SRC19, SNK14: what a subscriber would be given that comes with each job's last event, five seconds kept."""
    rows = table(spark, d, "progress")
    now = rows.groupBy("job_id").agg(F.max("received_at").alias("now"))
    return P.replayable(rows.join(now, "job_id"), F.col("now"), "5 seconds").groupBy("job_id").agg(F.count("*").alias("n"))


@R.add("""
SELECT job_id, count(*) AS late FROM progress WHERE received_at > ts + INTERVAL 10 SECOND GROUP BY job_id
""")
def late_events(spark: SparkSession, d: str) -> DataFrame:
    """Rows that came more than ten seconds late, by job."""
    return table(spark, d, "progress").where("received_at > ts + interval 10 seconds").groupBy("job_id").agg(F.count("*").alias("late"))


@R.add("""
SELECT job_id, sum((data IS NULL)::int)::BIGINT AS missing, sum((data IS NOT NULL AND NOT json_valid(data))::int)::BIGINT AS broken, count(*) AS n FROM progress GROUP BY job_id
""")
def event_data(spark: SparkSession, d: str) -> DataFrame:
    """How much of the events' data is missing or broken JSON."""
    broken = F.col("data").isNotNull() & F.expr("try_parse_json(data) is null")
    return table(spark, d, "progress").groupBy("job_id").agg(F.sum(F.col("data").isNull().cast("long")).alias("missing"), F.sum(broken.cast("long")).alias("broken"), F.count("*").alias("n"))


def _run_stream(spark: SparkSession, frame: DataFrame, mode: str) -> str:
    """Runs a stream over all that is there and gives the directory of its batches."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{at}/out"


def _stream_source(spark: SparkSession, d: str) -> DataFrame:
    return P.read_stream(spark, f"{d}/progress.parquet*")  # a file, or a directory of files


@R.add(STATE_SQL)
def stream_states(spark: SparkSession, d: str) -> DataFrame:
    """STR2-3: the same states as ``latest_job_state``, from the event files read as a stream."""
    out = _run_stream(spark, P.follow(_stream_source(spark, d), "30 days"), "update")
    rows = spark.read.parquet(out)
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("active", "completed", "events", "finished", "failed", "last_ts"), "batch").alias("s"))
    kept = cut(last.select("job_id", "s.*").withColumn("last_us", F.expr("unix_micros(last_ts)")).drop("last_ts"))
    Store(spark, out.removesuffix("/out"), "batch").drop_all()
    return kept
