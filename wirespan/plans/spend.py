"""Queries over usage events, requests and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.functions import prices as P
from wirespan.functions.times import bucket_label
from wirespan.operators import display, fleet, sessions, usage
from wirespan.plans import bindings as B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


COUNTERS_SQL = ", ".join(f"sum({c})::BIGINT AS {c}" for c in P.COUNTERS)
SUMS_SQL = f"{COUNTERS_SQL}, coalesce(sum(micro_cost), 0)::DOUBLE / 1e12 AS cost_usd, coalesce(bool_or(micro_cost IS NULL), false) AS has_unpriced, count(*) AS events, count(DISTINCT session_id) AS sessions"
DAY_SQL = {"daily": "strftime(make_timestamp((ts * 1000000)::BIGINT), '%Y-%m-%d')", "weekly": "strftime(make_timestamp((ts * 1000000)::BIGINT), '%G-W%V')", "monthly": "strftime(make_timestamp((ts * 1000000)::BIGINT), '%Y-%m')", "total": "'total'"}
LABEL_SQL = "array_to_string(list_sort(list(DISTINCT agent)), ',') AS label"
RATE_SQL = "CASE WHEN sum(prompt_tokens + cache_creation_tokens + cache_read_tokens) > 0 THEN sum(cache_read_tokens)::DOUBLE / sum(prompt_tokens + cache_creation_tokens + cache_read_tokens)::DOUBLE ELSE 0.0 END"

for _g in ("daily", "weekly", "monthly", "total"):
    query(f"usage_{_g}", f"WITH {B.USAGE_SQL} SELECT {DAY_SQL[_g]} AS bucket, {LABEL_SQL}, {SUMS_SQL} FROM usage_events GROUP BY 1")(lambda s, d, g=_g: usage.usage_rows(B.usage_events(s, d), g))


@query("usage_daily_tz", f"WITH {B.USAGE_SQL} SELECT strftime(make_timestamp((ts * 1000000)::BIGINT) - INTERVAL 8 HOUR, '%Y-%m-%d') AS bucket, {LABEL_SQL}, {SUMS_SQL} FROM usage_events GROUP BY 1")
def usage_daily_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_rows(B.usage_events(spark, sf_dir), "daily", tz="America/Los_Angeles")


@query("usage_breakdown_model", f"WITH {B.USAGE_SQL} SELECT {DAY_SQL['weekly']} AS bucket, model AS label, {SUMS_SQL} FROM usage_events GROUP BY 1, 2")
def usage_breakdown_model(spark, sf_dir):
    return usage.usage_rows(B.usage_events(spark, sf_dir), "weekly", by_model=True)


@query("usage_chart_collapse", f"WITH {B.USAGE_SQL} SELECT {DAY_SQL['monthly']} AS bucket, coalesce(sum(micro_cost), 0)::DOUBLE / 1e12 AS cost_usd FROM usage_events GROUP BY 1")
def usage_chart_collapse(spark, sf_dir):
    rows = B.usage_events(spark, sf_dir).withColumn("bucket", bucket_label(F.col("ts"), "monthly"))
    return rows.groupBy("bucket").agg(P.usd(F.coalesce(F.sum("micro_cost"), F.lit(0))).alias("cost_usd"))


@query("usage_totals", f"WITH {B.USAGE_SQL} SELECT {SUMS_SQL} FROM usage_events")
def usage_totals(spark, sf_dir):
    return usage.usage_totals(B.usage_events(spark, sf_dir))


@query("usage_unpriced", f"WITH {B.USAGE_SQL} SELECT DISTINCT model FROM usage_events WHERE micro_cost IS NULL")
def usage_unpriced(spark, sf_dir):
    return usage.unpriced_models(B.usage_events(spark, sf_dir))


@query("usage_statusline", f"WITH {B.USAGE_SQL} SELECT coalesce(sum(micro_cost) FILTER (WHERE d = '2024-01-15'), 0)::DOUBLE / 1e12 AS today_usd, coalesce(sum(micro_cost) FILTER (WHERE d[:7] = '2024-01' AND d <= '2024-01-15'), 0)::DOUBLE / 1e12 AS month_usd, coalesce(bool_or(micro_cost IS NULL AND d[:7] = '2024-01' AND d <= '2024-01-15'), false) AS has_unpriced FROM (SELECT *, {DAY_SQL['daily']} AS d FROM usage_events)")
def usage_statusline(spark, sf_dir):
    return usage.status_line(B.usage_events(spark, sf_dir), "2024-01-15")


@query("price_resolution", f"WITH {B.REQUESTS_SQL}, {B.RESOLVED_SQL} SELECT m.model, key, p_in, p_out, p_write, p_read FROM (SELECT DISTINCT model FROM requests) m LEFT JOIN resolved USING (model)")
def price_resolution(spark, sf_dir):
    return P.resolved(B.requests(spark, sf_dir), P.price_table(spark))


@query("price_overlay", f"""WITH {B.REQUESTS_SQL}, {B.RESOLVED_SQL.replace("ranked AS (", """overlaid AS (SELECT key, CASE WHEN key = 'o3' THEN 7000000 ELSE p_in END AS p_in, CASE WHEN key = 'o3' THEN 9000000 ELSE p_out END AS p_out, CASE WHEN key = 'o3' THEN 7000000 ELSE p_write END AS p_write, CASE WHEN key = 'o3' THEN 7000000 ELSE p_read END AS p_read FROM prices
  UNION ALL SELECT 'house-model', 1000000, 2000000, 1000000, 500000),
ranked AS (""").replace("JOIN prices p", "JOIN overlaid p")}
SELECT q.model, r.key, count(*) AS events, sum(prompt_tokens * p_in + completion_tokens * p_out + cache_creation_tokens * p_write + cache_read_tokens * p_read)::DOUBLE / 1e12 AS cost_usd FROM requests q LEFT JOIN resolved r ON q.model = r.model GROUP BY ALL""")
def price_overlay(spark, sf_dir):
    """What each model's requests cost with two prices laid over the built-in ones."""
    prices = P.price_table(spark, P.overlaid(P.BUILT_IN, {"o3": (7, 9, 7, 7), "house-model": (1, 2, 1, 0.5)}))
    return _by_model(B.requests(spark, sf_dir), prices)


def _by_model(requests, prices):
    rows = P.priced(requests, prices).groupBy("model").agg(F.count("*").alias("events"), P.usd(F.sum("micro_cost")).alias("cost_usd"))
    return rows.join(P.resolved(rows, prices).select("model", "key"), "model", "left").select("model", "key", "events", "cost_usd")


LISTING = {"sample_spec": {"input_cost_per_token": 1}, "a/gpt": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}, "b/gpt": {"input_cost_per_token": 3e-6, "output_cost_per_token": 4e-6}, "o3": {"input_cost_per_token": 1e-6, "output_cost_per_token": 0, "cache_read_input_token_cost": 1e-7}, "claude": {"input_cost_per_token": 0, "output_cost_per_token": 0}, "x/o3": {"input_cost_per_token": 9e-6, "output_cost_per_token": 9e-6}}


@query("litellm_convert", f"""WITH {B.REQUESTS_SQL}, listed(model, key, p_in, p_out, p_write, p_read) AS (VALUES ('gpt-5', 'gpt', 3000000::BIGINT, 4000000::BIGINT, 3000000::BIGINT, 3000000::BIGINT), ('o3', 'o3', 1000000, 0, 1000000, 100000))
SELECT q.model, key, count(*) AS events, sum(prompt_tokens * p_in + completion_tokens * p_out + cache_creation_tokens * p_write + cache_read_tokens * p_read)::DOUBLE / 1e12 AS cost_usd FROM requests q LEFT JOIN listed l ON l.model = q.model GROUP BY ALL""")
def litellm_convert(spark, sf_dir):
    """What each model's requests cost by a converted listing alone."""
    return _by_model(B.requests(spark, sf_dir), P.price_table(spark, P.converted(LISTING)))


STATS_SQL = f"""{B.USAGE_SQL},
stats AS (SELECT session_id, any_value(agent) AS agent, any_value(project_cwd) AS project_cwd, arg_max(model, seq) AS model, min(ts) AS started_at, max(ts) AS ended_at, {COUNTERS_SQL}, count(*) AS turns, count(*) FILTER (WHERE errored) AS errors,
  count(tool) AS tool_calls, sum(micro_cost) AS micro_cost, (max(ts) - min(ts)) * 1000 AS duration_ms, {RATE_SQL} AS cache_hit_rate, sum(micro_cost)::DOUBLE / 1e12 AS cost_usd FROM usage_events GROUP BY session_id)"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.session_stats(B.usage_events(spark, sf_dir))


STAT_COLUMNS = ["session_id", "agent", "project_cwd", "model", "started_at", "ended_at", *P.COUNTERS, "turns", "errors", "tool_calls", "cache_hit_rate", "cost_usd"]
STAT_SQL = ", ".join(STAT_COLUMNS)


@query("session_stats", f"WITH {STATS_SQL} SELECT {STAT_SQL} FROM stats")
def session_stats(spark, sf_dir):
    return stats(spark, sf_dir).select(*STAT_COLUMNS)


@query("session_rollup", f"WITH {STATS_SQL} SELECT count(*) AS sessions, {COUNTERS_SQL}, sum(turns)::BIGINT AS turns, sum(tool_calls)::BIGINT AS tool_calls, sum(floor(duration_ms)::BIGINT)::BIGINT AS wall_clock_ms, list_sort(list(DISTINCT model)) AS models, {RATE_SQL} AS cache_hit_rate, sum(micro_cost)::DOUBLE / 1e12 AS cost_usd FROM stats")
def session_rollup(spark, sf_dir):
    return usage.rollup(stats(spark, sf_dir))


@query("cache_hit_rate", f"WITH {B.REQUESTS_SQL} SELECT agent, {RATE_SQL} AS cache_hit_rate FROM requests GROUP BY 1")
def cache_hit_rate(spark, sf_dir):
    rows = B.requests(spark, sf_dir).groupBy("agent").agg(*(F.sum(c).alias(c) for c in P.COUNTERS))
    return rows.select("agent", P.cache_hit_rate(*(F.col(c) for c in (P.COUNTERS[0], P.COUNTERS[2], P.COUNTERS[3]))).alias("cache_hit_rate"))


@query("tool_histogram", f"WITH {B.REQUESTS_SQL} SELECT session_id, tool AS name, count(*) AS n FROM requests GROUP BY 1, 2")
def tool_histogram(spark, sf_dir):
    return stats(spark, sf_dir).select("session_id", F.explode("tool_histogram").alias("name", "n"))


@query("top_tools", f"WITH {B.REQUESTS_SQL} SELECT tool AS name, count(*) AS calls FROM requests GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_tools(spark, sf_dir):
    return usage.merged_histogram(stats(spark, sf_dir), 20)


@query("fleet_totals", f"WITH {B.USAGE_SQL} SELECT count(DISTINCT session_id) AS sessions, count(*) AS requests, count(*) FILTER (WHERE errored) AS errored, sum(micro_cost)::DOUBLE / 1e12 AS cost_usd, {COUNTERS_SQL}, {RATE_SQL} AS cache_hit_rate FROM usage_events")
def fleet_totals(spark, sf_dir):
    return fleet.totals(B.usage_events(spark, sf_dir))


@query("fleet_per_agent", f"WITH {B.USAGE_SQL} SELECT agent, count(DISTINCT session_id) AS sessions, coalesce(sum(micro_cost), 0)::DOUBLE / 1e12 AS cost_usd, sum(prompt_tokens)::BIGINT AS in_tokens, sum(completion_tokens)::BIGINT AS out_tokens FROM usage_events GROUP BY 1")
def fleet_per_agent(spark, sf_dir):
    return fleet.per_agent(B.usage_events(spark, sf_dir))


@query("fleet_per_project", f"WITH {B.USAGE_SQL} SELECT coalesce(project_cwd, '(unknown)') AS project, count(DISTINCT session_id) AS sessions, coalesce(sum(micro_cost), 0)::DOUBLE / 1e12 AS cost_usd, count(*) AS events, sum(completion_tokens)::BIGINT AS out_tokens FROM usage_events GROUP BY 1")
def fleet_per_project(spark, sf_dir):
    return fleet.per_project(B.usage_events(spark, sf_dir))


@query("project_treemap", f"""WITH RECURSIVE {B.USAGE_SQL},
costs AS (SELECT coalesce(project_cwd, '(unknown)') AS project, sum(micro_cost)::DOUBLE / 1e12 AS v FROM usage_events GROUP BY 1 HAVING sum(micro_cost) > 0),
items AS (SELECT project, v * 2.0 / sum(v) OVER () AS a, row_number() OVER (ORDER BY v DESC, project) AS k FROM costs),
fold AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS in_row, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 2.0::DOUBLE AS w, 1.0::DOUBLE AS h, 0.0::DOUBLE AS total, 0.0::DOUBLE AS before, 0.0::DOUBLE AS low, 0.0::DOUBLE AS high
  UNION ALL
  SELECT next, CASE WHEN closes THEN next ELSE greatest(in_row, 1) END, CASE WHEN closes AND w >= h THEN x + total / h ELSE x END, CASE WHEN closes AND w < h THEN y + total / w ELSE y END, CASE WHEN closes AND w >= h THEN w - total / h ELSE w END, CASE WHEN closes AND w < h THEN h - total / w ELSE h END,
    CASE WHEN closes THEN a ELSE total + a END, CASE WHEN closes THEN 0 ELSE total END, CASE WHEN closes OR total = 0 THEN a ELSE least(low, a) END, CASE WHEN closes THEN a ELSE greatest(high, a) END
  FROM (SELECT f.*, i.k AS next, i.a, total > 0 AND greatest(least(w, h) ^ 2 * greatest(high, i.a) / (total + i.a) ^ 2, (total + i.a) ^ 2 / (least(w, h) ^ 2 * least(low, i.a))) > greatest(least(w, h) ^ 2 * high / total ^ 2, total ^ 2 / (least(w, h) ^ 2 * low)) AS closes FROM fold f JOIN items i ON i.k = f.k + 1) t),
rows AS (SELECT *, max(total) OVER (PARTITION BY in_row) / least(w, h) AS thick FROM fold WHERE k > 0)
SELECT project AS label, round(r.x + CASE WHEN r.w < r.h THEN r.before / thick ELSE 0 END, 6) AS x, round(r.y + CASE WHEN r.w < r.h THEN 0 ELSE r.before / thick END, 6) AS y, round(CASE WHEN r.w < r.h THEN a / thick ELSE thick END, 6) AS w, round(CASE WHEN r.w < r.h THEN thick ELSE a / thick END, 6) AS h
FROM rows r JOIN items i ON i.k = r.k""")
def project_treemap(spark, sf_dir):
    costs = fleet.paid_projects(B.usage_events(spark, sf_dir))
    return display.treemap(costs, "project", "cost_usd", 2.0, 1.0).select("label", *(F.round(c, 6).alias(c) for c in "xywh"))


@query("paid_projects", f"WITH {B.USAGE_SQL} SELECT coalesce(project_cwd, '(unknown)') AS project, count(DISTINCT session_id) AS sessions, coalesce(sum(micro_cost), 0)::DOUBLE / 1e12 AS cost_usd, count(*) AS events, sum(completion_tokens)::BIGINT AS out_tokens FROM usage_events GROUP BY 1 HAVING coalesce(sum(micro_cost), 0) > 0")
def paid_projects(spark, sf_dir):
    return fleet.paid_projects(B.usage_events(spark, sf_dir))


@query("fleet_trend", f"WITH {B.USAGE_SQL} SELECT {DAY_SQL['daily']} AS day, coalesce(sum(micro_cost), 0)::DOUBLE / 1e12 AS cost_usd, count(*) AS events FROM usage_events WHERE ts > 0 GROUP BY 1 ORDER BY 1 DESC LIMIT 182")
def fleet_trend(spark, sf_dir):
    return fleet.daily_trend(B.usage_events(spark, sf_dir))


_Q = ", ".join(f"quantile_disc(ttft_ms, {q}) AS ttft_p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95))


@query("model_wire_metrics", f"WITH {B.REQUESTS_SQL} SELECT model, count(*) AS requests, count(*) FILTER (WHERE errored) AS errored, {_Q}, count(ttft_ms) AS ttft_n, quantile_disc(duration_ms, 0.5) AS duration_p50, sum(prompt_tokens)::BIGINT AS in_tokens, sum(completion_tokens)::BIGINT AS out_tokens, (count(*) FILTER (WHERE errored))::DOUBLE / count(*) AS error_rate FROM requests GROUP BY 1")
def model_wire_metrics(spark, sf_dir):
    return fleet.wire_metrics(B.requests(spark, sf_dir))


@query("session_ttft_p50", f"WITH {B.REQUESTS_SQL} SELECT session_id, quantile_disc(ttft_ms, 0.5) AS ttft_p50 FROM requests GROUP BY 1")
def session_ttft_p50(spark, sf_dir):
    return fleet.session_ttft(B.requests(spark, sf_dir))


_LAG = f"WITH {B.REQUESTS_SQL}, l AS (SELECT session_id, seq, lag(transcript_items) OVER (PARTITION BY session_id ORDER BY seq) AS items_from, transcript_items AS items_to FROM requests) SELECT"


@query("compaction_points", f"{_LAG} * FROM l WHERE items_from > 0 AND items_to < items_from")
def compaction_points(spark, sf_dir):
    return fleet.compactions(B.requests(spark, sf_dir))


@query("compaction_summary", f"{_LAG} count(*) AS compactions, count(DISTINCT session_id) AS sessions FROM l WHERE items_from > 0 AND items_to < items_from")
def compaction_summary(spark, sf_dir):
    return fleet.compaction_summary(B.requests(spark, sf_dir))


@query("request_waterfall", f"WITH {B.REQUESTS_SQL}, w AS (SELECT *, min(ts) OVER (PARTITION BY session_id) AS t0, max(ts + duration_ms / 1000.0::DOUBLE) OVER (PARTITION BY session_id) - min(ts) OVER (PARTITION BY session_id) AS span FROM requests) SELECT session_id, seq, round(CASE WHEN span > 0 THEN 100 * (ts - t0) / span ELSE 0 END, 6) AS offset_pct, round(CASE WHEN span > 0 THEN 100 * (duration_ms / 1000.0::DOUBLE) / span ELSE 0 END, 6) AS width_pct, duration_ms - ttft_ms AS streaming_ms FROM w")
def request_waterfall(spark, sf_dir):
    return fleet.waterfall(B.requests(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("offset_pct", "width_pct")})


@query("model_share_bars", f"WITH {B.REQUESTS_SQL} SELECT model, count(*) AS n, count(*)::DOUBLE / max(count(*)) OVER () AS share FROM requests GROUP BY 1")
def model_share_bars(spark, sf_dir):
    return fleet.share_of_most(B.requests(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n")), "n")


@query("top_sessions_by_cost", f"WITH {STATS_SQL} SELECT session_id, coalesce(cost_usd, 0) AS cost_usd FROM stats ORDER BY 2 DESC, 1 LIMIT 8")
def top_sessions_by_cost(spark, sf_dir):
    return stats(spark, sf_dir).select("session_id", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd")).orderBy(F.desc("cost_usd"), "session_id").limit(8)


def _listed(name: str, where: str, **filters):
    query(name, f"WITH {STATS_SQL} SELECT {STAT_SQL} FROM stats WHERE {where}")(lambda s, d: sessions.filtered(stats(s, d), **filters).select(*STAT_COLUMNS))


_listed("sessions_filter_model", "lower(model) LIKE '%opus%'", model="OPUS")
_listed("sessions_filter_agent", "lower(agent) = 'codex'", agent="Codex")
_listed("sessions_filter_project", "lower(project_cwd) LIKE '%work/p3%'", project="work/P3")
_listed("sessions_filter_time", "started_at >= 1704070000 AND started_at <= 1704100000", since=1704070000.0, until=1704100000.0)
_listed("sessions_filter_min_cost", "cost_usd IS NOT NULL AND cost_usd >= 0.02", min_cost=0.02)


@query("sessions_sorted", f"WITH {STATS_SQL} SELECT {STAT_SQL} FROM stats ORDER BY completion_tokens DESC NULLS LAST, session_id LIMIT 25")
def sessions_sorted(spark, sf_dir):
    return sessions.listed(stats(spark, sf_dir).select(*STAT_COLUMNS), "completion_tokens", True, 25)


@query("sessions_text_filter", f"WITH {STATS_SQL} SELECT {STAT_SQL} FROM stats WHERE lower(agent || ' ' || model || ' ' || coalesce(project_cwd, '') || ' ' || session_id) LIKE '%p4%'")
def sessions_text_filter(spark, sf_dir):
    return sessions.matching(stats(spark, sf_dir), "P4").select(*STAT_COLUMNS)


@query("sessions_with_error", f"WITH {STATS_SQL} SELECT session_id, agent FROM stats s WHERE EXISTS (SELECT 1 FROM requests r WHERE r.session_id = s.session_id AND r.errored)")
def sessions_with_error(spark, sf_dir):
    return sessions.with_steps(stats(spark, sf_dir), B.requests(spark, sf_dir), F.col("errored")).select("session_id", "agent")


@query("sessions_with_tool", f"WITH {STATS_SQL} SELECT session_id, agent FROM stats s WHERE EXISTS (SELECT 1 FROM requests r WHERE r.session_id = s.session_id AND r.tool = 'purchase' AND r.prompt_tokens > 90)")
def sessions_with_tool(spark, sf_dir):
    steps = B.requests(spark, sf_dir).filter("prompt_tokens > 90").withColumn("tool_names", F.array("tool"))
    return sessions.with_steps(stats(spark, sf_dir), steps, sessions.has_tool("Purchase")).select("session_id", "agent")


@query("session_turns_errors", f"WITH {STATS_SQL} SELECT session_id, (SELECT count(*) FROM requests r WHERE r.session_id = s.session_id) AS turns, (SELECT count(*) FROM requests r WHERE r.session_id = s.session_id AND r.errored) AS error_count FROM stats s")
def session_turns_errors(spark, sf_dir):
    return sessions.with_counts(stats(spark, sf_dir), B.requests(spark, sf_dir)).select("session_id", "turns", "error_count")


@query("usage_events_with_project", f"WITH {STATS_SQL} SELECT e.session_id, e.seq, e.ts, s.project_cwd FROM usage_events e LEFT JOIN stats s USING (session_id) WHERE e.ts >= 1704500000")
def usage_events_with_project(spark, sf_dir):
    events = B.usage_events(spark, sf_dir).select("session_id", "seq", "ts").filter("ts >= 1704500000")
    return events.join(stats(spark, sf_dir).select("session_id", "project_cwd"), "session_id", "left")


@query("table_counts", f"WITH {B.REQUESTS_SQL}, {B.STEPS_SQL} SELECT 'requests' AS name, count(*) AS n FROM requests UNION ALL SELECT 'steps', count(*) FROM steps UNION ALL SELECT 'sessions', count(DISTINCT session_id) FROM requests")
def table_counts(spark, sf_dir):
    requests = B.requests(spark, sf_dir)
    count = lambda name, df, n: df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n")
    return count("requests", requests, F.count("*")).union(count("steps", B.steps(spark, sf_dir), F.count("*"))).union(count("sessions", requests, F.count_distinct("session_id")))


@query("prompt_registry", f"WITH {B.PROMPT_CALLS_SQL} SELECT sha256(prompt) AS prompt_hash, arg_min(agent, seq) AS agent, arg_min(prompt, seq) AS content, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS request_count, count(DISTINCT session_id) AS session_count, floor(length(any_value(prompt)) / 4.0 + 0.5)::BIGINT AS approx_tokens FROM calls WHERE trim(prompt) <> '' GROUP BY 1")
def prompt_registry(spark, sf_dir):
    return sessions.prompt_registry(B.prompt_calls(spark, sf_dir))


_FIRST = "(SELECT sha256(text) FROM documents WHERE doc_id = 5)"


@query("prompt_sessions", f"WITH {B.PROMPT_CALLS_SQL} SELECT session_id, max(ts) AS last_used FROM calls WHERE sha256(prompt) = {_FIRST} GROUP BY 1")
def prompt_sessions(spark, sf_dir):
    calls = B.prompt_calls(spark, sf_dir)
    wanted = calls.filter("seq = 5").select(F.sha2(F.col("prompt").cast("binary"), 256).alias("h")).first()
    return sessions.prompt_sessions(calls, wanted.h if wanted else "")


@query("prompt_prefix_lookup", f"WITH {B.PROMPT_CALLS_SQL}, p AS (SELECT sha256(prompt) AS prompt_hash, max(ts) AS last_seen, count(*) AS request_count FROM calls WHERE trim(prompt) <> '' GROUP BY 1) SELECT * FROM p WHERE starts_with(prompt_hash, 'ab') ORDER BY last_seen DESC NULLS LAST, prompt_hash LIMIT 1")
def prompt_prefix_lookup(spark, sf_dir):
    return sessions.prompt_by_prefix(sessions.prompt_registry(B.prompt_calls(spark, sf_dir)), "AB").select("prompt_hash", "last_seen", "request_count")


@query("other_prompts", f"WITH {B.PROMPT_CALLS_SQL}, p AS (SELECT sha256(prompt) AS prompt_hash, arg_min(agent, seq) AS agent FROM calls WHERE trim(prompt) <> '' GROUP BY 1) SELECT a.agent, a.prompt_hash, count(*) AS others FROM p a JOIN p b ON a.agent = b.agent AND a.prompt_hash <> b.prompt_hash GROUP BY ALL")
def other_prompts(spark, sf_dir):
    """How many prompts of the same agent each prompt can be compared with."""
    registry = sessions.prompt_registry(B.prompt_calls(spark, sf_dir))
    return sessions.prompts_beside(registry)
