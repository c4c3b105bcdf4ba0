"""Session lists: filters, semi joins on steps, sorting by a whitelisted column; the prompt registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirespan.functions.texts import approx_tokens

SORTABLE = ("started_at", "ended_at", "duration_ms", "cost_usd", "prompt_tokens", "completion_tokens", "agent", "model")


def contains(column: str, part: str | None) -> Column:
    """Case-insensitive substring; everything where part is empty."""
    return F.contains(F.lower(F.col(column)), F.lit(part.lower())) if part else F.lit(True)


def filtered(sessions: DataFrame, *, model: str | None = None, project: str | None = None, agent: str | None = None, agent_part: str | None = None, since: float | None = None, until: float | None = None, min_cost: float | None = None, time: str = "started_at") -> DataFrame:
    """Rows that meet every given filter: substrings of model, project and agent, the exact agent, an inclusive range of
    time (rows without one are out of any bound), a least cost (rows without one never reach it)."""
    rows = sessions.filter(contains("model", model) & contains("project_cwd", project) & contains("agent", agent_part))
    if agent:
        rows = rows.filter(F.lower("agent") == agent.lower())
    if since is not None:
        rows = rows.filter(F.col(time) >= since)
    if until is not None:
        rows = rows.filter(F.col(time) <= until)
    if min_cost is not None:
        rows = rows.filter(F.col("cost_usd").isNotNull() & (F.col("cost_usd") >= min_cost))
    return rows


def with_steps(sessions: DataFrame, steps: DataFrame, condition: Column) -> DataFrame:
    """Sessions that have a step meeting condition."""
    return sessions.join(steps.filter(condition).select("session_id"), "session_id", "left_semi")


def has_tool(tool: str) -> Column:
    return F.array_contains(F.transform("tool_names", F.lower), tool.lower())


def with_counts(sessions: DataFrame, steps: DataFrame) -> DataFrame:
    """Sessions with their numbers of steps and of errored steps, 0 where none."""
    counts = steps.groupBy("session_id").agg(F.count("*").alias("turns"), F.count_if("errored").alias("error_count"))
    rows = sessions.drop("turns", "error_count").join(counts, "session_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("turns", "error_count")})


def listed(sessions: DataFrame, sort: str = "started_at", descending: bool = True, limit: float | None = None) -> DataFrame:
    """Sorted by a column of SORTABLE (any other name means started_at), nulls least, ties by session_id."""
    column = F.col(sort if sort in SORTABLE else "started_at")
    rows = sessions.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_first(), "session_id")
    return rows if limit is None else rows.limit(max(1, int(limit)))


def matching(sessions: DataFrame, text: str) -> DataFrame:
    """Sessions where text is part of agent, model, project, id or tool names, in any case."""
    return sessions.filter(F.contains(F.lower(F.concat_ws(" ", "agent", "model", "project_cwd", "session_id", F.array_join(F.map_keys("tool_histogram"), " "))), F.lit(text.lower())))


def prompt_registry(calls: DataFrame) -> DataFrame:
    """Each different prompt by its hash: agent and content of the first call, first and last time, calls, sessions."""
    rows = calls.filter(F.trim("prompt") != "").withColumn("prompt_hash", F.sha2(F.col("prompt").cast("binary"), 256))
    rows = rows.groupBy("prompt_hash").agg(F.min_by("agent", "seq").alias("agent"), F.min_by("prompt", "seq").alias("content"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("request_count"), F.count_distinct("session_id").alias("session_count"))
    return rows.withColumn("approx_tokens", approx_tokens(F.col("content")))


def prompt_sessions(calls: DataFrame, prompt_hash: str) -> DataFrame:
    """Sessions that used a prompt, by last use."""
    rows = calls.filter(F.sha2(F.col("prompt").cast("binary"), 256) == prompt_hash)
    return rows.groupBy("session_id").agg(F.max("ts").alias("last_used")).orderBy(F.col("last_used").desc_nulls_last(), "session_id")


def other_prompts(registry: DataFrame, prompt_hash: str) -> DataFrame:
    """The other prompts of a prompt's agent, which it can be compared with."""
    agent = registry.filter(F.col("prompt_hash") == prompt_hash).select("agent")
    return registry.join(agent, "agent", "left_semi").filter(F.col("prompt_hash") != prompt_hash)


def prompts_beside(registry: DataFrame) -> DataFrame:
    """agent, prompt_hash, others: how many prompts other_prompts gives for each, where there are any."""
    counts = registry.groupBy("agent").agg((F.count("*") - 1).alias("others")).filter("others > 0")
    return registry.select("agent", "prompt_hash").join(counts, "agent")


def prompt_by_prefix(registry: DataFrame, prefix: str) -> DataFrame:
    """The most recently seen prompt whose hash begins with prefix."""
    return registry.filter(F.startswith("prompt_hash", F.lit(prefix.lower()))).orderBy(F.col("last_seen").desc_nulls_last(), "prompt_hash").limit(1)
