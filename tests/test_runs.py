from __future__ import annotations

import datetime as dt

from lakemart import operators as ops

from helpers import row_set


def test_last_status_decides(spark):
    t = [dt.datetime(2024, 1, 1, 0, minute) for minute in range(4)]
    log = spark.createDataFrame(
        [
            ("a", 1, t[0], "NotStarted"), ("a", 2, t[2], "Completed"), ("a", 3, t[1], "Running"),
            ("b", 1, t[0], "Running"), ("b", 2, t[1], "Failed"),
            ("c", 1, t[0], "NotStarted"),
            ("d", 7, t[3], "Running"), ("d", 8, t[3], "Cancelled"),
            ("e", 1, t[0], "Failed"), ("e", 2, t[1], "Running"),
        ],
        "job_id string, poll_id bigint, ts timestamp, status string",
    )
    assert row_set(ops.final_status(log)) == [
        ("a", "Completed", "succeeded"),
        ("b", "Failed", "failed"),
        ("c", "NotStarted", "pending"),
        ("d", "Cancelled", "succeeded"),
        ("e", "Running", "pending"),
    ]


def test_failure_message_of_the_last_poll(spark):
    log = spark.createDataFrame(
        [("a", 1, 1, "Failed", "first"), ("a", 2, 2, "Failed", "last"), ("b", 1, 1, "Failed", "x"), ("b", 2, 2, "Completed", "y"), ("c", 1, 1, "Failed", None)],
        "job_id string, poll_id int, ts int, status string, reason string",
    )
    found = ops.final_status(log, message="reason")
    assert {r["job_id"]: r["failure"] for r in found.collect()} == {"a": "last", "b": None, "c": None}
    assert ops.final_status(log).columns == ["job_id", "last_status", "outcome"]
