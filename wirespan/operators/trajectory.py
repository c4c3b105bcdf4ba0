"""Trajectories from decoded pairs, as windows over conversations.

Each request repeats the conversation so far, so a user message or tool result is new where its place among its kind
passes the largest count of any earlier request. Agent steps come from responses. Results go to the step that made the
call, the latest one that did, or else to the latest agent step. A conversation is one source's pairs with one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirespan.functions import prices as P
from wirespan.functions.texts import looks_errored
from wirespan.functions.times import elapsed_ms

KEY = ["source_path", "adapter", "session_id"]
NOT_BLANK = r"[^\s  - 　﻿]"


def _of(items: str, kind: str, role: str | None = None) -> Column:
    return F.filter(items, lambda i: (i["kind"] == kind) & ((i["role"] == role) if role else F.lit(True)))


def conversations(records: DataFrame) -> DataFrame:
    """records with seq (from 0 in each conversation), what was new in each request, and whether it gave an agent step."""
    own = Window.partitionBy(*KEY).orderBy("pair_index")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = records.withColumns({"seq": F.row_number().over(own) - 1, "users": _of("items", "message", "user"), "results": _of("items", "tool_result"), "produced": (F.size("out_items") > 0) | F.col("usage").isNotNull()})
    for name in ("users", "results"):
        rows = rows.withColumn(f"{name}_seen", F.coalesce(F.max(F.size(name)).over(before), F.lit(0)))
    return rows.withColumn("agent_before", F.max(F.when(F.col("produced"), F.col("seq"))).over(before))


def observations(turns: DataFrame) -> DataFrame:
    """KEY, seq of the agent step, observations (source_call_id, content) in order."""
    new = turns.select(*KEY, "seq", "agent_before", "results_seen", F.posexplode("results").alias("at", "r")).filter("at >= results_seen")
    new = new.select(*KEY, "seq", "at", "agent_before", F.col("r.call_id").alias("call_id"), F.col("r.text").alias("content"), F.lit(None).cast("int").alias("made"))
    calls = turns.filter("produced").select(*KEY, "seq", F.explode(_of("out_items", "tool_call")).alias("c")).filter("c.call_id <> ''")
    calls = calls.select(*KEY, "seq", F.lit(1 << 30).alias("at"), F.lit(None).cast("int").alias("agent_before"), F.col("c.call_id").alias("call_id"), F.lit(None).cast("string").alias("content"), F.col("seq").alias("made"))
    # In the order of the log; a request's results come before the calls of its response.
    so_far = Window.partitionBy(*KEY, "call_id").orderBy("seq", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = new.unionByName(calls).withColumn("maker", F.last("made", ignorenulls=True).over(so_far)).filter("made is null")
    placed = placed.withColumn("step", F.coalesce("maker", "agent_before")).filter("step is not null")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "at", F.col("call_id").alias("source_call_id"), "content")))
    return placed.groupBy(*KEY, F.col("step").alias("seq")).agg(F.transform(ordered, lambda x: F.struct(x["source_call_id"].alias("source_call_id"), x["content"].alias("content"))).alias("observations"))


def steps(turns: DataFrame) -> DataFrame:
    """One row a step: KEY, step_index (from 1), role, message, reasoning, tool_calls, observations, usage, ts, seq."""
    users = turns.select(*KEY, "seq", "ts", "users_seen", F.posexplode("users").alias("at", "u")).filter((F.col("at") >= F.col("users_seen")) & F.col("u.text").rlike(NOT_BLANK))
    joined = lambda kind: F.array_join(F.transform(_of("out_items", kind), lambda i: i["text"]), "")
    agents = turns.filter("produced").select(
        *KEY, "seq", "ts", F.lit(1 << 30).alias("at"), F.lit("agent").alias("role"), joined("message").alias("message"), joined("reasoning").alias("reasoning"),
        F.transform(_of("out_items", "tool_call"), lambda i: F.struct(i["call_id"].alias("id"), i["name"].alias("name"), i["args_json"].alias("args_json"))).alias("tool_calls"), "usage",
    ).join(observations(turns), [*KEY, "seq"], "left")
    users = users.select(*KEY, "seq", "ts", "at", F.lit("user").alias("role"), F.col("u.text").alias("message"), F.lit("").alias("reasoning"))
    rows = agents.unionByName(users, allowMissingColumns=True)
    index = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq", "at"))
    return rows.withColumn("step_index", index).drop("at")


def search_rows(step_rows: DataFrame, *more: str) -> DataFrame:
    """Steps as the search index takes them: tool names, their arguments a line each, observations joined, errored; and
    the columns more."""
    # Arguments that are a JSON string count as the string itself.
    args = F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<id:string,name:string,args_json:string>>")), lambda c: F.coalesce(F.get_json_object(F.concat(F.lit('{"a":'), c["args_json"], F.lit("}")), "$.a"), c["args_json"], F.lit("")))
    observed = F.coalesce(F.array_join(F.transform("observations", lambda o: o["content"]), "\n"), F.lit(""))
    rows = step_rows.select(*KEY, "step_index", "role", "message", "reasoning", F.coalesce(F.transform("tool_calls", lambda c: c["name"]), F.array().cast("array<string>")).alias("tool_names"), F.array_join(args, "\n").alias("tool_input"), observed.alias("observation"), "ts", *more)
    return rows.withColumn("errored", looks_errored(F.col("observation")))


def request_rows(turns: DataFrame, step_rows: DataFrame) -> DataFrame:
    """One row a request: status, times, counters, stop reason, transcript length, prompt hash, index of its agent step."""
    index = step_rows.filter("role = 'agent'").select(*KEY, "seq", F.col("step_index").alias("agent_step_index"))
    counters = {c: F.coalesce(F.col(f"usage.{c}"), F.lit(0)) for c in (*P.COUNTERS, "reasoning_tokens")}
    rows = turns.select(
        *KEY, "seq", "agent", "ts", F.coalesce("response_model", "model").alias("model"), "status", (~F.col("has_response") | (F.col("status") >= 400)).alias("errored"),
        elapsed_ms(F.col("ts"), F.col("response_ts")).alias("duration_ms"), elapsed_ms(F.col("ts"), F.col("first_byte_ts")).alias("ttft_ms"), *(v.alias(k) for k, v in counters.items()), "stop_reason",
        F.size("items").alias("transcript_items"), F.coalesce(F.sha2(F.col("system_prompt").cast("binary"), 256), F.lit("")).alias("prompt_hash"), "system_prompt",
    )
    return rows.join(index, [*KEY, "seq"], "left")


def session_rows(turns: DataFrame, step_rows: DataFrame, prices: DataFrame) -> DataFrame:
    """One row a conversation: agent and model of its last pair, span of its steps, counters, cost, tool histogram."""
    heads = turns.groupBy(*KEY).agg(F.max_by("agent", "seq").alias("agent"), F.max_by("model", "seq").alias("model"))
    on = F.when(F.col("ts") > 0, F.col("ts"))
    sums = [F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).alias(c) for c in P.COUNTERS]
    body = step_rows.groupBy(*KEY).agg(F.coalesce(F.min(on), F.lit(0.0)).alias("started_at"), F.coalesce(F.max(on), F.lit(0.0)).alias("ended_at"), *sums, F.sum("usage.reasoning_tokens").alias("reasoning_tokens"), F.count_if(F.col("usage").isNotNull()).alias("events"), F.count("*").alias("steps"))
    tools = step_rows.select(*KEY, F.explode("tool_calls").alias("c")).groupBy(*KEY, F.coalesce(F.nullif(F.col("c.name"), F.lit("")), F.lit("(unnamed)")).alias("name")).agg(F.count("*").alias("n"))
    tools = tools.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("tool_histogram"))
    rows = heads.join(body, KEY).join(tools, KEY, "left")
    rows = P.priced(rows, prices).withColumn("cost_usd", P.usd(F.col("micro_cost"))).drop("micro_cost")
    return rows.withColumn("duration_ms", F.when(F.col("ended_at") > F.col("started_at"), (F.col("ended_at") - F.col("started_at")) * 1000).otherwise(F.lit(0.0)))


def usage_rows(step_rows: DataFrame, sessions: DataFrame, prices: DataFrame) -> DataFrame:
    """One event for each agent step with counters, priced as its session's model."""
    rows = step_rows.filter("usage is not null").select(*KEY, "step_index", F.when(F.col("ts") > 0, F.col("ts")).alias("ts"), "usage.*")
    return P.priced(rows.join(sessions.select(*KEY, "agent", "model"), KEY), prices)


def latest_source(sessions: DataFrame) -> DataFrame:
    """Of conversations with one session_id in several sources, the row of the last source by path."""
    last = sessions.groupBy("session_id").agg(F.max("source_path").alias("source_path"))
    return sessions.join(last, ["session_id", "source_path"], "left_semi")
