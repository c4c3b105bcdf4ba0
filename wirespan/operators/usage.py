"""Spend reports over usage events: buckets, totals, unpriced models, a status line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirespan.functions.prices import COUNTERS, cache_hit_rate, usd
from wirespan.functions.times import bucket_label


def _sums() -> list[Column]:
    return [*(F.sum(c).cast("long").alias(c) for c in COUNTERS), usd(F.coalesce(F.sum("micro_cost"), F.lit(0))).alias("cost_usd"), F.coalesce(F.bool_or(F.col("micro_cost").isNull()), F.lit(False)).alias("has_unpriced"), F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions")]


def usage_rows(events: DataFrame, granularity: str, by_model: bool = False, tz: str = "UTC") -> DataFrame:
    """One row a bucket, or a bucket and model: sums, cost of priced events, whether some have no price, events, distinct
    sessions, and as the group's label the model or the sorted agents."""
    rows = events.withColumn("bucket", bucket_label(F.col("ts"), granularity, tz))
    if by_model:
        return rows.groupBy("bucket", F.col("model").alias("label")).agg(*_sums())
    return rows.groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_set("agent")), ",").alias("label"), *_sums())


def usage_totals(events: DataFrame) -> DataFrame:
    """The grand total in one row; distinct sessions are counted anew, not added up from buckets."""
    return events.agg(*_sums())


def unpriced_models(events: DataFrame) -> DataFrame:
    return events.filter("micro_cost is null").select("model").distinct()


def status_line(events: DataFrame, today: str, tz: str = "UTC") -> DataFrame:
    """Spend of today and of its month so far, and whether either holds unpriced events; today is a local date."""
    day = bucket_label(F.col("ts"), "daily", tz)
    now, month = day == today, (F.substring(day, 1, 7) == today[:7]) & (day <= today)
    costs = [usd(F.coalesce(F.sum(F.when(w, F.col("micro_cost"))), F.lit(0))).alias(n) for n, w in (("today_usd", now), ("month_usd", month))]
    return events.agg(*costs, F.coalesce(F.bool_or(month & F.col("micro_cost").isNull()), F.lit(False)).alias("has_unpriced"))


def session_stats(requests: DataFrame) -> DataFrame:
    """One row a session: counters, hit rate, turns, tool calls, the histogram of tools, span of request starts, cost.

    requests: session_id, seq, ts, model, tool (null for none), counters, micro_cost. The model is the last request's.
    """
    tools = requests.groupBy("session_id", F.coalesce(F.nullif(F.col("tool"), F.lit("")), F.lit("(unnamed)")).alias("name")).agg(F.count("tool").alias("n")).filter("n > 0")
    tools = tools.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("tool_histogram"), F.sum("n").alias("tool_calls"))
    first, last = (f(F.when(F.col("ts") > 0, F.col("ts"))) for f in (F.min, F.max))
    stats = requests.groupBy("session_id").agg(
        F.first("agent").alias("agent"), F.first("project_cwd").alias("project_cwd"), F.max_by("model", "seq").alias("model"), F.coalesce(first, F.lit(0.0)).alias("started_at"), F.coalesce(last, F.lit(0.0)).alias("ended_at"),
        *(F.sum(c).cast("long").alias(c) for c in COUNTERS), F.count("*").alias("turns"), F.count_if("errored").alias("errors"), F.sum("micro_cost").alias("micro_cost"),
    )
    stats = stats.join(tools, "session_id", "left")
    rate = cache_hit_rate(*(F.col(c) for c in (COUNTERS[0], COUNTERS[2], COUNTERS[3])))
    return stats.withColumns({"duration_ms": F.when(F.col("ended_at") > F.col("started_at"), (F.col("ended_at") - F.col("started_at")) * 1000).otherwise(F.lit(0.0)), "cache_hit_rate": rate, "tool_calls": F.coalesce("tool_calls", F.lit(0)), "cost_usd": usd(F.col("micro_cost"))})


def rollup(stats: DataFrame) -> DataFrame:
    """All sessions in one row: sums, rate recomputed from sums, spans added up, cost null unless some session has one."""
    sums = stats.agg(F.count("*").alias("sessions"), *(F.sum(c).cast("long").alias(c) for c in COUNTERS), F.sum("turns").alias("turns"), F.sum("tool_calls").alias("tool_calls"), F.sum(F.floor("duration_ms").cast("long")).alias("wall_clock_ms"), F.sum("micro_cost").alias("m"), F.array_sort(F.collect_set("model")).alias("models"))
    return sums.withColumn("cache_hit_rate", cache_hit_rate(*(F.col(c) for c in (COUNTERS[0], COUNTERS[2], COUNTERS[3])))).withColumn("cost_usd", usd(F.col("m"))).drop("m")


def merged_histogram(stats: DataFrame, limit: int | None = None) -> DataFrame:
    """name and calls over all sessions' histograms, most first; the first `limit`, ties by name."""
    rows = stats.select(F.explode("tool_histogram").alias("name", "n")).groupBy("name").agg(F.sum("n").alias("calls"))
    return rows if limit is None else rows.orderBy(F.desc("calls"), "name").limit(limit)
