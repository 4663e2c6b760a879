"""One report assembled from independent aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logs, profile, regimes


def report(answers: DataFrame, register: DataFrame, obligations: DataFrame, pending_lines: DataFrame, resolution_lines: DataFrame, last_check: str | None = None) -> DataFrame:
    """One row: problems of the profile, regime and obligation counts, open entries by severity, unreadable lines, the last check."""
    from ..schema import PENDING, RESOLUTION

    read, done = logs.read_lines(pending_lines), logs.read_lines(resolution_lines, pending=False)
    open_now = logs.open_entries(logs.entries(read, PENDING), logs.entries(done, RESOLUTION))
    parts = [
        profile.checks(answers).agg(F.count(F.lit(1)).alias("profile_problems"), F.coalesce(F.bool_or("blocks"), F.lit(False)).alias("profile_blocks")),
        regimes.counts(register, obligations),
        logs.by_severity(open_now).withColumnRenamed("total", "open"),
        logs.unreadable(read, done),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.join(F.broadcast(part))  # a row each
    return whole.withColumn("last_check", F.lit(last_check))


def render(row: dict) -> str:
    """The report's lines."""
    return "\n".join(
        [
            f"profile: {'valid' if not row['profile_problems'] else str(row['profile_problems']) + ' problem(s)'}",
            f"regimes: {row['binds']} bind, {row['ruled_out']} ruled out, {row['undetermined']} undetermined, {row['no_longer_applies']} no longer apply",
            f"obligations: {row['obligations']} registered, {row['obligations_unclear']} unclear",
            f"pending: {row['open']} open (major {row['major']}, minor {row['minor']}, info {row['info']}), {row['unreadable']} unreadable lines",
            f"last check: {row['last_check'] or 'never'}",
        ]
    )
