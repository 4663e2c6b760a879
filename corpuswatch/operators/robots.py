"""robots.txt: group assembly by line order and verdicts by the longest matching pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import product_token, robots_regex
from ..storage import written


def rules(files: DataFrame) -> DataFrame:
    """host, agent, allow, pattern, ordered lines assembled into groups; files: host, text (at most 200,000 bytes each).

    Consecutive user-agent lines share the rules that follow; a user-agent
    line after a rule starts another group. An empty value adds no rule, yet
    ends the run of agents. A host's lines are one window, bounded by the size a robots file may have.
    """
    lines = files.select("host", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")).alias("at", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace(F.split_part("raw", F.lit("#"), F.lit(1)), r"[\x09-\x0d\x1c-\x1f]", " "))).where(F.contains("line", F.lit(":")))
    field = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1))))
    value = F.trim(F.expr("substring(line, instr(line, ':') + 1)"))
    rows = lines.select("host", "at", field.alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("at")
    agent = F.col("field") == "user-agent"
    starts = agent & F.coalesce(F.lag("field").over(order) != "user-agent", F.lit(True))
    rows = rows.withColumn("group", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = rows.where(agent & (F.col("group") > 0)).select("host", "group", product_token(F.col("value")).alias("agent"))
    said = rows.where(~agent & (F.col("group") > 0) & (F.col("value") != "")).select("host", "group", "at", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return agents.join(said, ["host", "group"]).select("host", "agent", "allow", "pattern", "at")


#: Parts that a host's requests are dealt in.
SALT = 16


def verdicts(requests: DataFrame, rules: DataFrame, agents: list[str]) -> DataFrame:
    """``requests`` (host, path) with ``allowed``: by the longest pattern that matches, an allow winning a tie, for each of ``agents`` (all must allow).

    An agent without a group of its own falls back to that of *; no rule, or
    none that matches, allows. A request without a host or path can't be held against any rule and is not allowed. Rules join on the host, so a request meets only those of its host;
    a host's requests are dealt over ``SALT`` parts, each of which gets the host's rules, bounded by the size of a robots file.
    """
    names = [product_token(F.lit(a)) for a in agents]
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt")
    rx = rules.select(F.col("host").alias("_host"), F.col("agent").alias("_agent"), "allow", "pattern", robots_regex(F.col("pattern")).alias("rx"), parts)
    there = rules.select(F.col("host").alias("_host"), F.col("agent").alias("_agent")).distinct().select("*", parts)
    whole = requests.where("host is not null and path is not null")
    asked = whole.select("host", "path").distinct().withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int")).withColumn("agent", F.explode(F.array(*names)))
    own = asked.join(there, F.expr("host = _host and agent = _agent and salt = _salt"), "left").select("host", "path", "salt", "agent", F.when(F.col("_host").isNotNull(), F.col("agent")).otherwise("*").alias("group"))
    matched = own.join(rx, F.expr("host = _host and `group` = _agent and salt = _salt and path rlike rx"), "left")
    best = matched.groupBy("host", "path", "agent").agg(F.max(F.when(F.col("rx").isNotNull(), F.struct(F.length("pattern").alias("n"), "allow"))).alias("best"))
    each = written(best.groupBy("host", "path").agg(F.bool_and(F.coalesce("best.allow", F.lit(True))).alias("allowed")), "robots-verdicts")  # so that a request made again and again is split
    nowhere = requests.where("host is null or path is null").withColumn("allowed", F.lit(False))
    return whole.join(each, ["host", "path"]).select(*requests.columns, "allowed").unionByName(nowhere)


def file_state(status: Column) -> Column:
    """What a host's robots answer means: rules, none (all is allowed), or unknown (the host is unreachable)."""
    return F.when(status.between(200, 299), "rules").when(status.between(400, 499), "none").otherwise("unknown")


def status_class(status: Column) -> Column:
    """What a status means to the fetcher: retried and then unreachable, or given to the adapter."""
    return F.when(status.isNull() | (status == 429) | (status >= 500), "unreachable").otherwise("answered")
