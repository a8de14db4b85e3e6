"""Progress events of jobs, as tables and as streams.

The same transformations serve both: a batch query over the event table replays what a stream over its
directory would have said. Events are (job_id, ts, event, message, data, received_at).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What ends a job's stream.
TERMINAL = ("stream:end", "job:cleanup:complete", "error", "job:error")
EVENTS = "job_id string, ts timestamp, event string, message string, data string, received_at timestamp"
STATE = "job_id string, active string, completed string, events long, finished boolean, failed boolean, last_ts timestamp"


def read_stream(spark: SparkSession, directory: str, files_at_once: int = 16) -> DataFrame:
    """SRC20, STR1: a stream over the parquet files that arrive in a directory."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(directory)


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """STR2, T29: each (job, event, ts) once; a stream forgets events older than ``late``.

    Rows without job, event or time are left out.
    """
    known = events.where("job_id is not null and event is not null and ts is not null")
    key = ["job_id", "event", "ts"]
    if events.isStreaming:
        return known.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
    return known.dropDuplicates(key)


def replayable(events: DataFrame, now, keep: str = "1 hour") -> DataFrame:
    """SRC19, SNK14: the events that a subscriber arriving at ``now`` is given: those received within ``keep``."""
    return events.where((F.col("received_at") <= now) & (F.col("received_at") > now - F.expr(f"interval {keep}")))


def stage(event: Column) -> Column:
    """The stage of phase:stage:start and the like; null for other events."""
    return F.when(event.rlike("^(phase|agent):[^:]+:(start|complete)$"), F.split(event, ":")[1])


def latest_state(events: DataFrame) -> DataFrame:
    """STR3-4: (job_id, active, completed, events, finished, failed, last_ts) of every job.

    ``active`` is the stage whose start came last if no completion came after it; ``completed`` lists the
    stages that completed, in alphabetical order. Late and repeated rows don't matter, order is by ts.
    """
    e = deduplicated(events)
    is_start, is_complete = F.col("event").endswith(":start"), F.col("event").endswith(":complete")
    grouped = e.groupBy("job_id").agg(
        F.max_by(F.when(is_start, stage(F.col("event"))), F.when(is_start, F.col("ts"))).alias("begun"),
        F.max(F.when(is_start, F.col("ts"))).alias("begun_at"),
        F.max(F.when(is_complete, F.col("ts"))).alias("done_at"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_complete, stage(F.col("event"))))), " ").alias("completed"),
        F.count("*").alias("events"),
        F.max(F.col("event").isin(*TERMINAL)).alias("finished"),
        F.max(F.col("event").isin("error", "job:error")).alias("failed"),
        F.max("ts").alias("last_ts"),
    )
    active = F.when(F.col("done_at").isNull() | (F.col("done_at") < F.col("begun_at")), F.col("begun"))
    return grouped.select("job_id", active.alias("active"), "completed", "events", "finished", "failed", "last_ts")


def windowed_counts(events: DataFrame, window: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Events by job and tumbling window of event time; in a stream a window closes after ``late``."""
    e = deduplicated(events, late)
    return e.groupBy("job_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).select("job_id", F.col("w.start").alias("begins"), "n")


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    begun, begun_at, done_at, completed, seen, finished, failed, last = state.get if state.exists else ("", 0, 0, "", 0, False, False, 0)
    done = set(completed.split())
    for rows in batches:
        for event, ts in zip(rows["event"], rows["ts"]):
            at = pd.Timestamp(ts).value
            seen, last = seen + 1, max(last, at)
            finished, failed = finished or event in TERMINAL, failed or event in ("error", "job:error")
            part = event.split(":")
            if len(part) == 3 and part[0] in ("phase", "agent"):
                if part[2] == "start" and at >= begun_at:
                    begun, begun_at = part[1], at
                elif part[2] == "complete":
                    done.add(part[1])
                    done_at = max(done_at, at)
    completed = " ".join(sorted(done))
    state.update((begun, begun_at, done_at, completed, seen, finished, failed, last))
    active = begun if begun and done_at < begun_at else None
    yield pd.DataFrame({"job_id": [key[0]], "active": [active], "completed": [completed], "events": [seen], "finished": [finished], "failed": [failed], "last_ts": [pd.Timestamp(last)]})


def follow(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """STR2-3: the stream of every job's state, one row for each job that a batch touched."""
    kept = "begun string, begun_at long, done_at long, completed string, seen long, finished boolean, failed boolean, last long"
    return deduplicated(events, late).groupBy("job_id").applyInPandasWithState(_follow, STATE, kept, "update", GroupStateTimeout.NoTimeout)
