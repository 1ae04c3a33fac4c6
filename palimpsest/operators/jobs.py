"""Comparison jobs as tables: latest state, pending set, retries, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Retry bound and ages in hours.
MAX_ATTEMPTS = 2
JOB_HOURS = 24
IMAGE_HOURS = 12
FINISHED = ["done", "error"]
PENDING = ["queued", "processing"]


def latest_state(log: DataFrame) -> DataFrame:
    """Last update of each job: an aggregate with map-side combine, so a job with very many updates is no hot spot."""
    last = F.max_by(F.struct("username", "status", "files_deleted"), F.struct("ts", "event_id"))
    return log.groupBy("job_id").agg(last.alias("_r"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at")).select(
        "job_id", "_r.*", "created_at", "updated_at")


def pending(jobs: DataFrame) -> DataFrame:
    """Unfinished jobs, all of them queued again."""
    return jobs.filter(F.col("status").isin(PENDING)).withColumn("status", F.lit("queued"))


def is_purgeable(now: Column, hours: int = JOB_HOURS) -> Column:
    return (F.col("status").isin(FINISHED) & F.col("files_deleted")
            & (F.col("created_at") < now - F.make_dt_interval(F.lit(0), F.lit(hours))))


def retries(log: DataFrame, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Failed jobs go back to the queue until they have failed ``limit`` times."""
    return log.groupBy("job_id").agg(F.count_if(F.col("status") == "error").alias("failures")).filter("failures > 0").withColumn(
        "next_status", F.when(F.col("failures") < limit, "queued").otherwise("error"))


def history(jobs: DataFrame, username: str | None = None) -> DataFrame:
    """Jobs newest first, optionally of one user."""
    j = jobs if username is None else jobs.filter(F.col("username") == username)
    return j.orderBy(F.col("username"), F.col("created_at").desc(), F.col("job_id"))


def status_view(jobs: DataFrame) -> DataFrame:
    """Per user: jobs in all and by state."""
    return jobs.groupBy("username").agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(F.col("status") == s).alias(s) for s in ("queued", "processing", "done", "error")])


def is_deletable(path: Column, modified: Column, now: Column, hours: int = IMAGE_HOURS) -> Column:
    """Left-over temporary files at once, other files after some hours."""
    return path.endswith(".tmp") | (modified < now - F.make_dt_interval(F.lit(0), F.lit(hours)))
