"""Logs, from the events table: an event is an entry, its type the severity or kind, its user the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import log_id
from ..operators import freshness, logs, robots
from ..session import table
from .registry import query

SEVERITY = "CASE event_id % 4 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' WHEN 2 THEN 'info' ELSE 'other' END"
ID = "'chg-' || CASE WHEN event_id < 10000 THEN lpad(CAST(event_id AS VARCHAR), 4, '0') ELSE CAST(event_id AS VARCHAR) END"
PENDING = f"SELECT {ID} AS id, event_type AS kind, {SEVERITY} AS severity, 'user-' || user_id AS source FROM events"
RESOLVED = f"SELECT {ID} AS id FROM events WHERE event_id % 3 = 0"


def pending(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_id") % 4 == 0, "major").when(F.col("event_id") % 4 == 1, "minor").when(F.col("event_id") % 4 == 2, "info").otherwise("other")
    return e.select(log_id(F.col("event_id")).alias("id"), F.col("event_type").alias("kind"), severity.alias("severity"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"), "event_id")


def resolutions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 3 = 0").select(log_id(F.col("event_id")).alias("id"))


@query(f"SELECT id, kind, severity, source FROM ({PENDING}) WHERE id NOT IN ({RESOLVED})")
def open_entries_anti_join(spark, sf_dir):
    return logs.open_entries(pending(spark, sf_dir), resolutions(spark, sf_dir)).select("id", "kind", "severity", "source")


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'info') AS info
    FROM ({PENDING}) WHERE id NOT IN ({RESOLVED})"""
)
def severity_counts_fixed_domain(spark, sf_dir):
    return logs.by_severity(logs.open_entries(pending(spark, sf_dir), resolutions(spark, sf_dir)))


LINE = """CASE event_id % 7 WHEN 0 THEN '{not json' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"id": "chg-1", "kind": 7, "severity": "info"}'
    WHEN 3 THEN '{"id": "", "kind": "k", "severity": "info"}' WHEN 4 THEN '  ' ELSE '{"id": "chg-' || event_id || '", "kind": "' || event_type || '", "severity": "info"}' END"""


@query(
    """SELECT CAST(count(*) FILTER (event_id % 7 IN (0, 1, 2, 3)) + count(*) FILTER (event_id % 5 = 0 AND event_id % 2 = 0) AS BIGINT) AS unreadable FROM events"""
)
def log_unreadable_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first = events.select(F.expr(LINE).alias("value"))
    second = events.where("event_id % 5 = 0").select(F.expr("""CASE WHEN event_id % 2 = 0 THEN '{"note": 1}' ELSE '{"id": "chg-1", "action": "applied"}' END""").alias("value"))
    return logs.unreadable(logs.read_lines(first), logs.read_lines(second, pending=False))


@query(
    f"""WITH last AS (SELECT max(event_id) AS last FROM events WHERE event_id % 2 = 0),
    new AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events)
    SELECT event_id, 'chg-' || CASE WHEN last + n < 10000 THEN lpad(CAST(last + n AS VARCHAR), 4, '0') ELSE CAST(last + n AS VARCHAR) END AS id FROM new CROSS JOIN last"""
)
def next_sequential_ids(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    old = events.where("event_id % 2 = 0")
    odd = events.where("event_id % 2 = 0").select(F.concat(F.lit("old-"), F.col("event_id").cast("string")).alias("id"))
    return logs.with_ids(events.select("event_id"), ["event_id"], old.select(log_id(F.col("event_id")).alias("id")), odd)


_KEYED = "SELECT event_id, event_type AS kind, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS source FROM events"


@query(
    f"""WITH rows AS ({_KEYED}), open AS (SELECT DISTINCT kind, source FROM rows WHERE event_id % 40 = 0)
    SELECT DISTINCT kind, source FROM rows r WHERE NOT EXISTS (SELECT 1 FROM open o WHERE o.kind = r.kind AND o.source IS NOT DISTINCT FROM r.source)"""
)
def refile_suppression(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("source"))
    return logs.suppress(rows.select("kind", "source"), rows.where("event_id % 40 = 0"), ["kind", "source"])


@query(
    f"""WITH asked AS (SELECT 'chg-' || CASE WHEN event_id * 2 < 10000 THEN lpad(CAST(event_id * 2 AS VARCHAR), 4, '0') ELSE CAST(event_id * 2 AS VARCHAR) END AS id,
        CASE WHEN event_id % 11 = 0 THEN 'erased' ELSE 'applied' END AS action FROM events),
    known AS (SELECT DISTINCT {ID} AS id FROM events), done AS (SELECT DISTINCT {ID} AS id FROM events WHERE event_id % 3 = 0)
    SELECT id, action, CASE WHEN action = 'erased' THEN 'bad action' WHEN id NOT IN (SELECT id FROM known) THEN 'unknown id' WHEN id IN (SELECT id FROM done) THEN 'already resolved' ELSE 'ok' END AS verdict FROM asked"""
)
def resolve_guard(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    asked = events.select(log_id(F.col("event_id") * 2).alias("id"), F.when(F.col("event_id") % 11 == 0, "erased").otherwise("applied").alias("action"))
    return logs.guard_resolutions(asked, pending(spark, sf_dir), resolutions(spark, sf_dir))


_STATE = "CASE WHEN status IS NULL OR status = 429 OR status >= 500 THEN 'unreachable' WHEN value > 100 THEN 'moved' ELSE 'fresh' END"
_STATUS = "CASE event_id % 50 WHEN 0 THEN 503 WHEN 1 THEN 429 WHEN 2 THEN NULL WHEN 3 THEN 404 ELSE 200 END"


@query(
    f"""WITH results AS (SELECT {_STATE} AS state FROM (SELECT value, {_STATUS} AS status FROM events))
    SELECT count(*) FILTER (state = 'fresh') AS fresh, count(*) FILTER (state = 'unreachable') AS unreachable, count(*) FILTER (state = 'moved') AS moved,
    CAST(CASE WHEN count(*) = 0 THEN 2 WHEN count(*) FILTER (state = 'unreachable') > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit FROM results"""
)
def run_counters(spark, sf_dir):
    status = F.expr(_STATUS.replace("VARCHAR", "STRING"))
    lost = robots.status_class(status) == "unreachable"
    state = F.when(lost, "unreachable").when(F.col("value") > 100, "moved").otherwise("fresh")
    return freshness.run_report(table(spark, sf_dir, "events").select(state.alias("freshness")))


@query(
    """SELECT event_id, event_type AS id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events m WHERE m.event_id % 10 = 0 AND m.event_id = e.event_id)"""
)
def new_feed_entries(spark, sf_dir):
    from ..operators import manifest

    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("id"))
    return manifest.new_entries(events, events.where("event_id % 10 = 0"), ["event_id"])
