"""Fleet analytics: totals, breakdowns, trend, latency percentiles, context compactions, request layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirespan.functions.prices import COUNTERS, cache_hit_rate, usd
from wirespan.functions.times import utc_day

TREND_DAYS = 182


def _cost() -> Column:
    return usd(F.coalesce(F.sum("micro_cost"), F.lit(0))).alias("cost_usd")


def totals(events: DataFrame) -> DataFrame:
    rows = events.agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("requests"), F.count_if("errored").alias("errored"), _cost(), *(F.sum(c).cast("long").alias(c) for c in COUNTERS))
    return rows.withColumn("cache_hit_rate", cache_hit_rate(*(F.col(c) for c in (COUNTERS[0], COUNTERS[2], COUNTERS[3]))))


def per_agent(events: DataFrame) -> DataFrame:
    return events.groupBy("agent").agg(F.count_distinct("session_id").alias("sessions"), _cost(), F.sum("prompt_tokens").alias("in_tokens"), F.sum("completion_tokens").alias("out_tokens"))


def per_project(events: DataFrame) -> DataFrame:
    project = F.coalesce(F.nullif(F.col("project_cwd"), F.lit("")), F.lit("(unknown)")).alias("project")
    return events.groupBy(project).agg(F.count_distinct("session_id").alias("sessions"), _cost(), F.count("*").alias("events"), F.sum("completion_tokens").alias("out_tokens"))


def paid_projects(events: DataFrame) -> DataFrame:
    """Projects that cost anything, as a map of areas shows them."""
    return per_project(events).filter("cost_usd > 0")


def daily_trend(events: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    """day, cost, events of the last so many UTC days that have events, in order; events without a time don't count."""
    rows = events.filter("ts > 0").groupBy(utc_day(F.col("ts")).alias("day")).agg(_cost(), F.count("*").alias("events"))
    return rows.orderBy(F.desc("day")).limit(days).orderBy("day")


def percentile(column: str, q: float) -> Column:
    """Exact nearest-rank percentile of whole numbers; null of nothing."""
    return F.expr(f"cast(percentile_disc({q}) WITHIN GROUP (ORDER BY {column}) AS bigint)")


def wire_metrics(requests: DataFrame) -> DataFrame:
    """Per model: requests, errors, percentiles of the time to first byte and of the duration, token sums."""
    quantiles = [percentile("ttft_ms", q).alias(f"ttft_p{round(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)]
    rows = requests.groupBy(F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("(unknown)")).alias("model")).agg(
        F.count("*").alias("requests"), F.count_if("errored").alias("errored"), *quantiles, F.count("ttft_ms").alias("ttft_n"), percentile("duration_ms", 0.5).alias("duration_p50"),
        F.sum("prompt_tokens").alias("in_tokens"), F.sum("completion_tokens").alias("out_tokens"),
    )
    return rows.withColumn("error_rate", F.col("errored").cast("double") / F.col("requests"))


def session_ttft(requests: DataFrame) -> DataFrame:
    return requests.groupBy("session_id").agg(percentile("ttft_ms", 0.5).alias("ttft_p50"))


def compactions(requests: DataFrame) -> DataFrame:
    """session_id, seq, items_from, items_to of each request whose transcript is shorter than the one before."""
    before = F.lag("transcript_items").over(Window.partitionBy("session_id").orderBy("seq"))
    rows = requests.select("session_id", "seq", before.alias("items_from"), F.col("transcript_items").alias("items_to"))
    return rows.filter("items_from > 0 AND items_to < items_from")


def with_compactions(requests: DataFrame) -> DataFrame:
    """Requests with items_from of the compaction that each is, null where it is none."""
    return requests.join(compactions(requests).select("session_id", "seq", "items_from"), ["session_id", "seq"], "left")


def compaction_summary(requests: DataFrame) -> DataFrame:
    return compactions(requests).agg(F.count("*").alias("compactions"), F.count_distinct("session_id").alias("sessions"))


def waterfall(requests: DataFrame) -> DataFrame:
    """Offset and width of each request as shares (percent) of its session's span, and its streaming time."""
    own = Window.partitionBy("session_id")
    end = F.col("ts") + F.coalesce("duration_ms", F.lit(0)) / 1000
    rows = requests.filter("ts > 0").withColumn("t0", F.min("ts").over(own)).withColumn("span", F.max(end).over(own) - F.col("t0"))
    share = lambda x: F.when(F.col("span") > 0, 100 * x / F.col("span")).otherwise(F.lit(0.0))
    return rows.select("session_id", "seq", share(F.col("ts") - F.col("t0")).alias("offset_pct"), share(F.coalesce("duration_ms", F.lit(0)) / 1000).alias("width_pct"), (F.col("duration_ms") - F.col("ttft_ms")).alias("streaming_ms"))


def share_of_most(rows: DataFrame, column: str) -> DataFrame:
    """rows (a few, already aggregated) with share: column over its largest value."""
    most = rows.agg(F.max(column).alias("most"))
    return rows.crossJoin(F.broadcast(most)).withColumn("share", F.when(F.col("most") > 0, F.col(column).cast("double") / F.col("most")).otherwise(F.lit(0.0))).drop("most")
