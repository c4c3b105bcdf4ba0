"""The engine's tables over the driver's tables, as DataFrames and as DuckDB SQL with the same names and columns.

requests and usage_events come from events (a session for each user), steps from conversations, prompts and texts with
planted tokens from documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.functions import prices as P

#: The model that stands for each type of event.
MODELS = {"view": "gpt-5", "click": "claude-sonnet-4-20250514", "purchase": "CLAUDE-OPUS-4-1-20250805", "signup": "o3"}
UNPRICED = "house-model"
AGENTS = ("claude", "codex", "gemini")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request an event: session_id, seq, ts, model, agent, project, status, duration, time to first byte, counters."""
    e = table(spark, sf_dir, "events")
    micros = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
    model = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODELS.items()) + f" ELSE '{UNPRICED}' END"
    return e.select(
        F.expr("concat('u', cast(user_id as string))").alias("session_id"),
        F.expr("row_number() over (partition by user_id order by ts, event_id) - 1").cast("long").alias("seq"),
        F.expr(f"{micros} / 1000000.0D").alias("ts"),
        F.expr(model).alias("model"),
        F.expr("element_at(array('claude','codex','gemini'), cast(user_id % 3 as int) + 1)").alias("agent"),
        F.expr("CASE WHEN user_id % 11 <> 0 THEN concat('/work/p', cast(user_id % 7 as string)) END").alias("project_cwd"),
        F.expr("event_type").alias("tool"),
        F.expr("CASE WHEN event_type = 'error' THEN 500 ELSE 200 END").alias("status"),
        F.expr("event_type = 'error'").alias("errored"),
        F.expr("cast(floor(value * 10) as bigint)").alias("duration_ms"),
        F.expr("CASE WHEN event_id % 5 <> 0 THEN cast(floor(value * 3) as bigint) END").alias("ttft_ms"),
        F.expr("cast(get_json_object(props, '$.k') as bigint)").alias("transcript_items"),
        F.expr("cast(get_json_object(props, '$.k') as bigint)").alias("prompt_tokens"),
        F.expr("cast(floor(value) as bigint)").alias("completion_tokens"),
        F.expr("cast(get_json_object(props, '$.k') as bigint) * (event_id % 3)").alias("cache_creation_tokens"),
        F.expr("cast(get_json_object(props, '$.k') as bigint) * (event_id % 7)").alias("cache_read_tokens"),
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event a request, with its cost if its model has a price."""
    return P.priced(requests(spark, sf_dir), P.price_table(spark))


REQUESTS_SQL = f"""requests AS (
  SELECT 'u' || user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, epoch_us(ts) / 1000000.0::DOUBLE AS ts,
    CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MODELS.items())} ELSE '{UNPRICED}' END AS model,
    ['claude','codex','gemini'][user_id % 3 + 1] AS agent, CASE WHEN user_id % 11 <> 0 THEN '/work/p' || (user_id % 7) END AS project_cwd, event_type AS tool,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, event_type = 'error' AS errored, floor(value * 10)::BIGINT AS duration_ms,
    CASE WHEN event_id % 5 <> 0 THEN floor(value * 3)::BIGINT END AS ttft_ms, (props->>'k')::BIGINT AS transcript_items, (props->>'k')::BIGINT AS prompt_tokens,
    floor(value)::BIGINT AS completion_tokens, (props->>'k')::BIGINT * (event_id % 3) AS cache_creation_tokens, (props->>'k')::BIGINT * (event_id % 7) AS cache_read_tokens
  FROM events)"""

PRICES_SQL = "prices(key, p_in, p_out, p_write, p_read) AS (VALUES " + ", ".join(f"('{k}', {', '.join(f'{round(p * 1_000_000)}::BIGINT' for p in v)})" for k, v in P.BUILT_IN.items()) + ")"

RESOLVED_SQL = f"""{PRICES_SQL},
ranked AS (SELECT m.model, p.*, row_number() OVER (PARTITION BY m.model ORDER BY CASE WHEN m.model = p.key THEN 2 WHEN lower(m.model) = p.key THEN 1 ELSE 0 END DESC, length(p.key) DESC, p.key DESC) AS r
  FROM (SELECT DISTINCT model FROM requests) m JOIN prices p ON starts_with(lower(m.model), lower(p.key))),
resolved AS (SELECT * FROM ranked WHERE r = 1)"""

USAGE_SQL = f"""{REQUESTS_SQL}, {RESOLVED_SQL},
usage_events AS (SELECT q.*, prompt_tokens * p_in + completion_tokens * p_out + cache_creation_tokens * p_write + cache_read_tokens * p_read AS micro_cost
  FROM requests q LEFT JOIN resolved r ON q.model = r.model)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step a turn of conversations, with a failing tool's output planted on every seventh."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.expr("concat('c', cast(conv_id as string))").alias("session_id"),
        F.expr("cast(turn + 1 as int)").alias("step_index"),
        F.expr("CASE role WHEN 'assistant' THEN 'agent' ELSE role END").alias("role"),
        F.expr("text").alias("message"),
        F.lit("").alias("reasoning"),
        F.expr("CASE WHEN (conv_id + turn) % 7 = 0 THEN array('Bash') WHEN (conv_id + turn) % 7 = 1 THEN array('Read', 'Edit') ELSE array() END").alias("tool_names"),
        F.expr("CASE WHEN (conv_id + turn) % 7 = 0 THEN '{\"command\":\"make\"}' ELSE '' END").alias("tool_input"),
        F.expr("CASE WHEN (conv_id + turn) % 7 = 0 THEN 'make: Permission Denied' WHEN (conv_id + turn) % 7 = 1 THEN 'terror ok' ELSE '' END").alias("observation"),
    )


STEPS_SQL = """steps AS (SELECT 'c' || conv_id AS session_id, (turn + 1)::INT AS step_index, CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS role, text AS message, '' AS reasoning,
  CASE WHEN (conv_id + turn) % 7 = 0 THEN ['Bash'] WHEN (conv_id + turn) % 7 = 1 THEN ['Read', 'Edit'] ELSE [] END AS tool_names,
  CASE WHEN (conv_id + turn) % 7 = 0 THEN '{"command":"make"}' ELSE '' END AS tool_input,
  CASE WHEN (conv_id + turn) % 7 = 0 THEN 'make: Permission Denied' WHEN (conv_id + turn) % 7 = 1 THEN 'terror ok' ELSE '' END AS observation FROM conversations)"""


def step_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the steps: agent, model, project, start and cost by the number of the conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.select(
        F.expr("concat('c', cast(conv_id as string))").alias("session_id"),
        F.expr("element_at(array('claude','codex','gemini'), cast(conv_id % 3 as int) + 1)").alias("agent"),
        F.expr("element_at(array('claude-sonnet-4','gpt-5','gemini-2.5-pro'), cast(conv_id % 3 as int) + 1)").alias("model"),
        F.expr("concat('/work/p', cast(conv_id % 7 as string))").alias("project_cwd"),
        F.expr("cast(1700000000 + conv_id * 3600 as double)").alias("started_at"),
        F.expr("CASE WHEN conv_id % 3 <> 2 THEN cast(conv_id % 10 as double) / 10 END").alias("cost_usd"),
    )


STEP_SESSIONS_SQL = """step_sessions AS (SELECT DISTINCT 'c' || conv_id AS session_id, ['claude','codex','gemini'][conv_id % 3 + 1] AS agent, ['claude-sonnet-4','gpt-5','gemini-2.5-pro'][conv_id % 3 + 1] AS model,
  '/work/p' || (conv_id % 7) AS project_cwd, (1700000000 + conv_id * 3600)::DOUBLE AS started_at, CASE WHEN conv_id % 3 <> 2 THEN (conv_id % 10)::DOUBLE / 10 END AS cost_usd FROM conversations)"""


def prompt_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call a document: its text as the system prompt."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.expr("element_at(array('claude','codex','gemini'), cast(doc_id % 3 as int) + 1)").alias("agent"),
        F.expr("concat('s', cast(doc_id % 97 as string))").alias("session_id"),
        F.expr("CASE WHEN doc_id % 13 <> 0 THEN cast(1700000000 + doc_id as double) END").alias("ts"),
        F.expr("doc_id").alias("seq"),
        F.expr("text").alias("prompt"),
    )


PROMPT_CALLS_SQL = """calls AS (SELECT ['claude','codex','gemini'][doc_id % 3 + 1] AS agent, 's' || (doc_id % 97) AS session_id, CASE WHEN doc_id % 13 <> 0 THEN (1700000000 + doc_id)::DOUBLE END AS ts, doc_id AS seq, text AS prompt FROM documents)"""


def planted(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents, every tenth with a token of some provider's shape at its end; doc_id, text and the columns named in more."""
    d = table(spark, sf_dir, "documents")
    hexed = "sha2(cast(doc_id as string), 256)"
    token = f"""CASE doc_id % 50 WHEN 0 THEN concat('ghp_', substring({hexed}, 1, 36)) WHEN 10 THEN concat('sk-', substring({hexed}, 1, 40))
      WHEN 20 THEN concat('Bearer ', substring({hexed}, 1, 30)) WHEN 30 THEN concat('AKIA', upper(substring({hexed}, 1, 16))) ELSE concat('xoxb-', substring({hexed}, 1, 24)) END"""
    return d.select("doc_id", F.expr(f"CASE WHEN doc_id % 10 = 0 THEN concat(coalesce(text, ''), ' ', {token}) ELSE text END").alias("text"), *more)


PLANTED_SQL = """planted AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN coalesce(text, '') || ' ' || CASE doc_id % 50 WHEN 0 THEN 'ghp_' || substr(sha256(doc_id::VARCHAR), 1, 36)
  WHEN 10 THEN 'sk-' || substr(sha256(doc_id::VARCHAR), 1, 40) WHEN 20 THEN 'Bearer ' || substr(sha256(doc_id::VARCHAR), 1, 30)
  WHEN 30 THEN 'AKIA' || upper(substr(sha256(doc_id::VARCHAR), 1, 16)) ELSE 'xoxb-' || substr(sha256(doc_id::VARCHAR), 1, 24) END ELSE text END AS text FROM documents)"""
