"""Outcome of job runs from the log of polled statuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statuses that mean a run is not over, and the one that means failure.
PENDING = ("NotStarted", "Running")
FAILED = ("Failed",)


def final_status(
    log: DataFrame,
    job: str = "job_id",
    status: str = "status",
    ts: str = "ts",
    poll: str = "poll_id",
    pending: Sequence[str] = PENDING,
    failed: Sequence[str] = FAILED,
    message: str | None = None,
) -> DataFrame:
    """The last status of every job and whether it is pending, failed or succeeded.

    The latest time decides, the larger poll id on a tie; any status not listed
    counts as success. Each task reduces its rows to one per job before the
    shuffle, so a job with very many polls is no problem. With ``message``, the
    last poll's column of that name is added for failed jobs as ``failure``.
    """
    last = F.col("last_status")
    fields = [(ts, "t"), (poll, "p"), (status, "s")] + ([(message, "m")] if message else [])
    polled = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in fields])
    outcome = (
        F.when(last.isin(list(pending)), "pending")
        .when(last.isin(list(failed)), "failed")
        .otherwise("succeeded")
    )
    jobs = log.groupBy(F.col(f"`{job}`").alias("job")).agg(F.max(polled).alias("last"))
    jobs = jobs.select("job", F.col("last.s").alias("last_status"), "last")
    failure = F.when(last.isin(list(failed)), F.col("last.m")) if message else None
    return jobs.select(
        F.col("job").alias(job),
        "last_status",
        outcome.alias("outcome"),
        *([failure.alias("failure")] if message else []),
    )
