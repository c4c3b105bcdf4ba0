"""Queries that rebuild trajectories from wire logs written out of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirespan.functions import prices as P
from wirespan.operators import atif, compare, display, fleet, trajectory
from wirespan.plans import bindings as B
from wirespan.session import scratch
from wirespan.sources.wire import decoded
from wirespan.streaming import state

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def logs(spark, sf_dir, tools: bool = False):
    """source_path, pair_index, raw: a log for each conversation, a pair for each assistant turn, whose request holds
    all turns before it. With tools, each assistant turn calls a tool and each other turn brings a result for the call
    that the turn before it would have made."""
    c = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = "named_struct('type', 'text', 'text', text)"
    if tools:
        own = f"CASE WHEN role = 'assistant' THEN concat('[', to_json({said}), ',', to_json(named_struct('type', 'tool_use', 'id', concat('call', cast(turn as string)), 'name', 'Bash', 'input', named_struct('n', turn))), ']') ELSE concat('[', to_json(named_struct('type', 'tool_result', 'tool_use_id', concat('call', cast(turn - 1 as string)), 'content', concat('out', cast(turn as string)))), ',', to_json({said}), ']') END"
    else:
        own = f"concat('[', to_json({said}), ']')"
    c = c.withColumn("content", F.expr(own)).withColumn("m", F.expr("concat('{\"role\":\"', role, '\",\"content\":', content, '}')"))
    before = "over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)"
    c = c.withColumn("messages", F.expr(f"concat('[', array_join(collect_list(m) {before}, ','), ']')")).filter("role = 'assistant'")
    raw = """concat('{"request":{"timestamp":', cast(1700000000 + conv_id * 1000 + turn as string), ',"method":"POST","url":"https://host/v1/messages","body":{"model":"claude-sonnet-4","system":"Conversation ', cast(conv_id as string),
      ' cch=0f;","messages":', messages, '}},"response":{"timestamp":', cast(1700000000 + conv_id * 1000 + turn as string), '.5,"first_byte_timestamp":', cast(1700000000 + conv_id * 1000 + turn as string), '.25,"status_code":200,"body":{"model":"claude-sonnet-4","content":', content,
      ',"stop_reason":"end_turn","usage":{"input_tokens":', cast(10 * turn + 1 as string), ',"output_tokens":', cast(turn as string), ',"cache_read_input_tokens":7}}}}')"""
    return c.select(F.expr("concat('log', cast(conv_id as string))").alias("source_path"), F.col("turn").alias("pair_index"), F.expr(raw).alias("raw"))


def turns(spark, sf_dir, tools: bool = False):
    return trajectory.conversations(decoded(logs(spark, sf_dir, tools)))


STEPS_SQL = """c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_turn FROM conversations),
kept AS (SELECT * FROM c WHERE role = 'assistant' OR (turn < last_turn AND trim(text) <> '')),
steps AS (SELECT 'log' || conv_id AS source_path, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS step_index, CASE WHEN role = 'assistant' THEN 'agent' ELSE 'user' END AS role, text AS message, conv_id, turn FROM kept)"""


@query("traj_steps", f"WITH {STEPS_SQL} SELECT source_path, step_index, role, message FROM steps")
def traj_steps(spark, sf_dir):
    return trajectory.steps(turns(spark, sf_dir)).select("source_path", "step_index", "role", "message")


@query("traj_step_counts", f"WITH {STEPS_SQL} SELECT source_path, count(*) FILTER (WHERE role = 'agent') AS agent_steps, count(*) FILTER (WHERE role = 'user') AS user_steps FROM steps GROUP BY 1")
def traj_step_counts(spark, sf_dir):
    rows = trajectory.steps(turns(spark, sf_dir)).groupBy("source_path")
    return rows.agg(F.count_if(F.col("role") == "agent").alias("agent_steps"), F.count_if(F.col("role") == "user").alias("user_steps"))


@query("traj_request_link", f"WITH {STEPS_SQL} SELECT source_path, row_number() OVER (PARTITION BY source_path ORDER BY turn) - 1 AS seq, 200 AS status, 500::BIGINT AS duration_ms, 250::BIGINT AS ttft_ms, (10 * turn + 1)::BIGINT AS prompt_tokens, 'end_turn' AS stop_reason, turn AS transcript_items, step_index AS agent_step_index FROM steps WHERE role = 'agent'")
def traj_request_link(spark, sf_dir):
    t = turns(spark, sf_dir)
    rows = trajectory.request_rows(t, trajectory.steps(t))
    return rows.select("source_path", F.col("seq").cast("long").alias("seq"), "status", "duration_ms", "ttft_ms", "prompt_tokens", "stop_reason", F.col("transcript_items").cast("long").alias("transcript_items"), "agent_step_index")


@query("traj_usage_events", f"WITH {STEPS_SQL} SELECT source_path, step_index, (1700000000 + conv_id * 1000 + turn)::DOUBLE AS ts, (10 * turn + 1)::BIGINT AS prompt_tokens, turn AS completion_tokens, 7::BIGINT AS cache_read_tokens, ((10 * turn + 1) * 3000000 + turn * 15000000 + 7 * 300000)::DOUBLE / 1e12 AS cost_usd FROM steps WHERE role = 'agent'")
def traj_usage_events(spark, sf_dir):
    t, prices = turns(spark, sf_dir), P.price_table(spark)
    s = trajectory.steps(t)
    rows = trajectory.usage_rows(s, trajectory.session_rows(t, s, prices), prices)
    return rows.select("source_path", "step_index", "ts", "prompt_tokens", "completion_tokens", "cache_read_tokens", P.usd(F.col("micro_cost")).alias("cost_usd"))


@query("traj_sessions", f"WITH {STEPS_SQL} SELECT source_path, 'claude' AS agent, 'claude-sonnet-4' AS model, (1700000000 + conv_id * 1000 + min(turn) FILTER (WHERE role = 'agent'))::DOUBLE AS started_at, sum(CASE WHEN role = 'agent' THEN 10 * turn + 1 END)::BIGINT AS prompt_tokens, count(*) AS steps FROM steps GROUP BY source_path, conv_id")
def traj_sessions(spark, sf_dir):
    t = turns(spark, sf_dir)
    return trajectory.session_rows(t, trajectory.steps(t), P.price_table(spark)).select("source_path", "agent", "model", "started_at", "prompt_tokens", "steps")


@query("traj_stitch", f"""WITH {STEPS_SQL}, made AS (SELECT source_path, conv_id, turn, step_index FROM steps WHERE role = 'agent'),
results AS (SELECT conv_id, turn, 'out' || turn AS content FROM c WHERE role <> 'assistant' AND turn < last_turn),
placed AS (SELECT r.conv_id, r.content, r.turn, (SELECT max(m.turn) FROM made m WHERE m.conv_id = r.conv_id AND m.turn < r.turn) AS at FROM results r)
SELECT m.source_path, m.step_index, p.content FROM placed p JOIN made m ON m.conv_id = p.conv_id AND m.turn = p.at""")
def traj_stitch(spark, sf_dir):
    rows = trajectory.steps(turns(spark, sf_dir, tools=True)).filter("observations is not null")
    return rows.select("source_path", "step_index", F.explode("observations").alias("o")).select("source_path", "step_index", "o.content")


@query("traj_state_steps", f"""WITH {STEPS_SQL}, made AS (SELECT source_path, conv_id, turn, step_index FROM steps WHERE role = 'agent'),
placed AS (SELECT conv_id, 'out' || turn AS content, turn, (SELECT max(m.turn) FROM made m WHERE m.conv_id = c.conv_id AND m.turn < c.turn) AS at_turn FROM c WHERE role <> 'assistant' AND turn < last_turn),
stitched AS (SELECT conv_id, at_turn, string_agg(content, ',' ORDER BY turn) AS observed FROM placed GROUP BY ALL)
SELECT source_path, step_index, role, message, observed FROM steps s LEFT JOIN stitched p ON s.role = 'agent' AND p.conv_id = s.conv_id AND p.at_turn = s.turn""")
def traj_state_steps(spark, sf_dir):
    """Steps out of a stream's state: the logs come in three appended parts, each followed to its end by a query that goes on
    from the checkpoint of the one before."""
    folder, pairs = scratch(spark, "state"), logs(spark, sf_dir, tools=True)
    key, provider = state.STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        for part in ("pair_index < 3", "pair_index >= 3 and pair_index < 8", "pair_index >= 8"):
            pairs.filter(part).write.mode("append").parquet(f"{folder}/pairs")
            stream = spark.readStream.schema(pairs.schema).parquet(f"{folder}/pairs")
            found = state.events(decoded(stream)).writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/checkpoint")
            found.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    steps = state.steps_of(spark.read.schema(state.EVENT).parquet(f"{folder}/events"))
    return steps.select("source_path", "step_index", "role", "message", F.array_join(F.transform("observations", lambda o: o["content"]), ",").alias("observed"))


@query("traj_tool_calls", f"WITH {STEPS_SQL} SELECT source_path, step_index, 'call' || turn AS id, 'Bash' AS name, '{{\"n\":' || turn || '}}' AS args_json FROM steps WHERE role = 'agent'")
def traj_tool_calls(spark, sf_dir):
    return trajectory.steps(turns(spark, sf_dir, tools=True)).select("source_path", "step_index", F.explode("tool_calls").alias("c")).select("source_path", "step_index", "c.*")


@query("atif_export")
def atif_export(spark, sf_dir):
    """One interchange document a conversation: its log, number of steps and size."""
    t = turns(spark, sf_dir, tools=True)
    docs = atif.documents(t, trajectory.steps(t))
    return docs.select("source_path", F.get_json_object("document", "$.schema_version").alias("schema_version"), F.get_json_object("document", "$.final_metrics.total_steps").cast("int").alias("total_steps"), F.length("document").alias("size"))


#: The step that each result goes to, and a user's step's time: that of the request that first holds it.
STITCHED_SQL = f"""{STEPS_SQL}, made AS (SELECT source_path, conv_id, turn, step_index FROM steps WHERE role = 'agent'),
placed AS (SELECT conv_id, 'out' || turn AS content, turn, (SELECT max(m.turn) FROM made m WHERE m.conv_id = c.conv_id AND m.turn < c.turn) AS at_turn FROM c WHERE role <> 'assistant' AND turn < last_turn),
stitched AS (SELECT conv_id, at_turn, string_agg(content, ',' ORDER BY turn) AS results FROM placed GROUP BY ALL),
asked AS (SELECT s.*, (SELECT min(m.turn) FROM made m WHERE m.conv_id = s.conv_id AND m.turn >= s.turn) AS asked_in FROM steps s)"""


@query("atif_steps", f"""WITH {STITCHED_SQL}
SELECT source_path, step_index AS step_id, role AS source, message, strftime(to_timestamp(1700000000 + a.conv_id * 1000 + asked_in) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp, CASE WHEN role = 'agent' THEN 'claude-sonnet-4' END AS model_name,
  CASE WHEN role = 'agent' THEN 'call' || turn || ' Bash ' || turn END AS calls, results, CASE WHEN role = 'agent' THEN (10 * turn + 1)::BIGINT END AS prompt_tokens, CASE WHEN role = 'agent' THEN 7::BIGINT END AS cached_tokens
FROM asked a LEFT JOIN stitched p ON a.role = 'agent' AND p.conv_id = a.conv_id AND p.at_turn = a.turn""")
def atif_steps(spark, sf_dir):
    """The steps of the interchange documents, as they stand in the documents' text."""
    t = turns(spark, sf_dir, tools=True)
    schema = """steps array<struct<step_id:int,source:string,message:string,timestamp:string,model_name:string,tool_calls:array<struct<tool_call_id:string,function_name:string,arguments:struct<n:bigint>>>,
      observation:struct<results:array<struct<content:string,source_call_id:string>>>,metrics:struct<prompt_tokens:bigint,completion_tokens:bigint,cached_tokens:bigint>>>"""
    rows = atif.documents(t, trajectory.steps(t)).select("source_path", F.inline(F.from_json("document", schema)["steps"]))
    calls = F.transform("tool_calls", lambda c: F.concat_ws(" ", c["tool_call_id"], c["function_name"], c["arguments"]["n"].cast("string")))
    return rows.select("source_path", "step_id", "source", "message", "timestamp", "model_name", F.array_join(calls, ",").alias("calls"), F.array_join(F.col("observation.results.content"), ",").alias("results"), "metrics.prompt_tokens", "metrics.cached_tokens")


@query("atif_metrics", f"""WITH {STEPS_SQL} SELECT source_path, 'ATIF-v1.7' AS schema_version, 'claude' AS agent, count(*)::INT AS total_steps, sum(10 * turn + 1) FILTER (WHERE role = 'agent')::BIGINT AS total_prompt_tokens, sum(turn) FILTER (WHERE role = 'agent')::BIGINT AS total_completion_tokens,
  (7 * count(*) FILTER (WHERE role = 'agent'))::BIGINT AS total_cached_tokens FROM steps GROUP BY 1""")
def atif_metrics(spark, sf_dir):
    """Heads and final metrics of the interchange documents."""
    t = turns(spark, sf_dir, tools=True)
    docs = atif.documents(t, trajectory.steps(t))
    of = lambda path, kind: F.get_json_object("document", f"$.{path}").cast(kind).alias(path.split(".")[-1])
    totals = [of(f"final_metrics.total_{n}", "long") for n in ("prompt_tokens", "completion_tokens", "cached_tokens")]
    return docs.select("source_path", of("schema_version", "string"), F.get_json_object("document", "$.agent.name").alias("agent"), of("final_metrics.total_steps", "int"), *totals)


@query("traj_digest", f"""WITH {STITCHED_SQL},
shown AS (SELECT source_path, a.conv_id, turn, role, results, trim(regexp_replace(message, '[\\s]+', ' ', 'g')) AS said FROM asked a LEFT JOIN stitched p ON a.role = 'agent' AND p.conv_id = a.conv_id AND p.at_turn = a.turn),
lines AS (SELECT source_path, concat_ws(chr(10), CASE WHEN said <> '' THEN CASE WHEN role = 'agent' THEN 'AGENT: ' ELSE 'USER: ' END || CASE WHEN length(said) > {display.MESSAGE} THEN said[1:{display.MESSAGE}] || '…' ELSE said END END,
  CASE WHEN role = 'agent' THEN '  TOOL Bash({{"n":' || turn || '}})' END, '    -> ' || replace(results, ',', chr(10) || '    -> ')) AS line FROM shown),
sized AS (SELECT source_path, '## Session — claude (claude-sonnet-4)' AS head, sum(length(line) + 1) AS n FROM lines WHERE line <> '' GROUP BY 1)
SELECT source_path, (CASE WHEN length(head) + n > {display.DIGEST} THEN {display.DIGEST * 60 // 100} + {display.DIGEST * 35 // 100} + length('..…[trajectory truncated]…..') ELSE length(head) + n END)::INT AS size, head FROM sized""")
def traj_digest(spark, sf_dir):
    """The digest of each log, by its size and first line."""
    t = turns(spark, sf_dir, tools=True)
    heads = t.groupBy(*trajectory.KEY).agg(F.min("pair_index").alias("at"), F.max_by("agent", "seq").alias("agent"), F.max_by("model", "seq").alias("model"))
    rows = display.digests(trajectory.steps(t), heads)
    return rows.select("source_path", F.length("digest").alias("size"), F.substring_index("digest", "\n", 1).alias("head"))


def _compared(metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT 'shape' AS section, '{name}' AS name, a.{name}::DOUBLE AS a, b.{name}::DOUBLE AS b FROM halves a JOIN halves b ON a.half = 0 AND b.half = 1" for name in metrics)


_METRICS = {
    "steps": "count(*)", "user_steps": "count(*) FILTER (WHERE role = 'user')", "agent_steps": "count(*) FILTER (WHERE role = 'agent')", "tool_calls": "count(*) FILTER (WHERE role = 'agent')",
    "prompt_tokens": "sum(10 * turn + 1) FILTER (WHERE role = 'agent')", "completion_tokens": "sum(turn) FILTER (WHERE role = 'agent')", "cache_creation_tokens": "0", "cache_read_tokens": "7 * count(*) FILTER (WHERE role = 'agent')",
    "trajectories": "count(DISTINCT source_path)", "cost_usd": "(sum((10 * turn + 1) * 3000000 + turn * 15000000 + 7 * 300000) FILTER (WHERE role = 'agent'))::DOUBLE / 1e12",
}


@query("run_compare", f"""WITH {STEPS_SQL}, halves AS (SELECT conv_id % 2 AS half, {', '.join(f'{sql} AS {name}' for name, sql in _METRICS.items())} FROM steps GROUP BY 1)
SELECT section, name, round(a, 6) AS a, round(b, 6) AS b FROM ({_compared(_METRICS)} UNION ALL SELECT 'calls', 'Bash', a.tool_calls, b.tool_calls FROM halves a JOIN halves b ON a.half = 0 AND b.half = 1)""")
def run_compare(spark, sf_dir):
    """Shape and calls of two runs: the logs of even and of odd conversations."""
    pairs = logs(spark, sf_dir, tools=True)
    half = F.substring("source_path", 4, 20).cast("long") % 2
    tables = compare.compare(*(compare.run_of(decoded(pairs.filter(half == h))) for h in (0, 1)))
    rows = compare.listed({**tables, "prompt": tables["prompt"].limit(0)}).filter("section in ('shape', 'calls')")
    return rows.select("section", "name", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in "ab"))


@query("traj_summary", f"WITH {STEPS_SQL} SELECT count(*) AS pair_count, count(DISTINCT source_path) AS trajectory_count, sum(10 * turn + 1)::BIGINT AS prompt_tokens, sum(turn)::BIGINT AS completion_tokens, 0::BIGINT AS cache_creation_tokens, (7 * count(*))::BIGINT AS cache_read_tokens FROM steps WHERE role = 'agent'")
def traj_summary(spark, sf_dir):
    t = turns(spark, sf_dir)
    return display.summary(t, trajectory.session_rows(t, trajectory.steps(t), P.price_table(spark))).drop("reasoning_tokens")


@query("tool_headline", f"WITH {STEPS_SQL} SELECT source_path, step_index, 'make ' || turn AS headline, 'command' AS kind FROM steps WHERE role = 'agent'")
def tool_headline(spark, sf_dir):
    calls = trajectory.steps(turns(spark, sf_dir, tools=True)).select("source_path", "step_index", F.explode("tool_calls").alias("c"))
    args = F.to_json(F.struct(F.concat(F.lit("make "), F.get_json_object("c.args_json", "$.n")).alias("command"), F.lit("x").alias("description")))
    return calls.select("source_path", "step_index", display.headline(args).alias("headline"), display.call_kind(args).alias("kind"))


@query("trend_calendar", f"WITH {B.USAGE_SQL}, t AS (SELECT strftime(make_timestamp((ts * 1000000)::BIGINT), '%Y-%m-%d') AS day, coalesce(sum(micro_cost), 0)::DOUBLE / 1e12 AS cost_usd FROM usage_events GROUP BY 1), g AS (SELECT unnest(generate_series(DATE '2023-07-30', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS d) SELECT d::VARCHAR AS day, floor(date_diff('day', DATE '2023-07-30', d) / 7)::INT AS week, dayofweek(d)::INT AS weekday, coalesce(cost_usd, 0.0) AS cost_usd, CASE WHEN cost_usd > 0 THEN round(0.22 + 0.78 * sqrt(cost_usd / (SELECT max(cost_usd) FROM t)), 2) END AS opacity FROM g LEFT JOIN t ON t.day = g.d::VARCHAR")
def trend_calendar(spark, sf_dir):
    return display.calendar(fleet.daily_trend(B.usage_events(spark, sf_dir)), "2024-01-30")


@query("short_numbers", f"WITH {B.USAGE_SQL}, t AS (SELECT agent, sum(cache_read_tokens)::BIGINT AS n FROM usage_events GROUP BY 1) SELECT agent, CASE WHEN n >= 10000000 THEN printf('%.0f', n / 1e6) || 'M' WHEN n >= 1000000 THEN printf('%.1f', n / 1e6) || 'M' WHEN n >= 100000 THEN printf('%.0f', n / 1e3) || 'K' WHEN n >= 1000 THEN printf('%.1f', n / 1e3) || 'K' ELSE n::VARCHAR END AS tokens FROM t")
def short_numbers(spark, sf_dir):
    rows = B.usage_events(spark, sf_dir).groupBy("agent").agg(F.sum("cache_read_tokens").alias("n"))
    return rows.select("agent", display.short_tokens(F.col("n")).alias("tokens"))


_MS = "doc_id * doc_id * 1400"


@query("durations", f"""WITH d AS (SELECT doc_id, {_MS} AS ms FROM documents), t AS (SELECT *, ms / 1000 AS s, ms // 60000 AS m FROM d)
SELECT doc_id, CASE WHEN ms <= 0 THEN '0s' WHEN ms < 10000 THEN printf('%.1fs', s) WHEN ms < 60000 THEN printf('%.0fs', s) WHEN m < 60 THEN m::VARCHAR || 'm ' || floor(s % 60 + 0.5)::BIGINT::VARCHAR || 's' ELSE (m // 60)::VARCHAR || 'h ' || (m % 60)::VARCHAR || 'm' END AS report,
  CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', s) WHEN m < 60 THEN m::VARCHAR || 'm ' || floor(s % 60 + 0.5)::BIGINT::VARCHAR || 's' ELSE (m // 60)::VARCHAR || 'h ' || (m % 60)::VARCHAR || 'm' END AS request FROM t""")
def durations(spark, sf_dir):
    ms = F.expr(_MS)
    return B.table(spark, sf_dir, "documents").select("doc_id", display.report_duration(ms).alias("report"), display.request_duration(ms).alias("request"))


def _json(**fields: str) -> str:
    """SQL of a JSON object from the SQL of its values; those that begin with '{' or '[' in JSON are given as raw()."""
    parts = ", ',', ".join(f"""'"{k}":', {v.removeprefix('raw:') if v.startswith('raw:') else f"substring(to_json(array({v})), 2, length(to_json(array({v}))) - 2)"}""" for k, v in fields.items())
    return f"concat('{{', {parts}, '}}')"


def raw(sql: str) -> str:
    return f"raw:{sql}"


def _list(*items: str) -> str:
    return raw("concat('[', " + ", ',', ".join(items) + ", ']')")


def _events(*items: tuple[str, str]) -> str:
    return "concat(" + ", ".join(f"'event: {name}\\ndata: ', {data}, '\\n\\n'" for name, data in items) + ")"


_TEXT = "said"
_ID, _BEFORE = "concat('call', cast(turn as string))", "concat('call', cast(turn - 1 as string))"
_OUT, _THINK = "concat('out', cast(turn as string))", "concat('think', cast(turn as string))"
_ARGS = _json(n="turn")
_IN, _MADE = "10 * turn + 1", "turn + 2"


def _codex() -> tuple[str, str, str, str]:
    call = _json(type="'function_call'", call_id=_ID, name="'shell'", arguments=_ARGS)
    said = lambda role, kind: _json(type="'message'", role=role, content=_list(_json(type=kind, text=_TEXT)))
    mine = f"concat({said(repr('assistant'), repr('output_text'))}, ',', {call})"
    other = f"concat({_json(type=repr('function_call_output'), call_id=_BEFORE, output=_OUT)}, ',', {said(repr('user'), repr('input_text'))})"
    body = _json(model="'gpt-5'", prompt_cache_key="concat('k', cast(conv_id as string))", instructions="'Be brief.'", input=raw("concat('[', items, ']')"))
    used = _json(input_tokens=_IN, output_tokens=_MADE, input_tokens_details=raw(_json(cached_tokens="7")), output_tokens_details=raw(_json(reasoning_tokens="2")))
    output = _list(_json(type="'reasoning'", summary=_list(_json(text=_THINK))), said("'assistant'", "'output_text'"), call)
    done = _json(type="'response.completed'", response=raw(_json(model="'gpt-5'", status="'completed'", output=output, usage=raw(used))))
    return mine, other, body, _events(("response.completed", done))


def _gemini() -> tuple[str, str, str, str]:
    text = lambda t, **more: _json(text=t, **more)
    call = _json(functionCall=raw(_json(id=_ID, name="'shell'", args=raw(_ARGS))))
    back = _json(functionResponse=raw(_json(id=_BEFORE, name="'shell'", response=raw(_json(output=_OUT)))))
    mine, other = _json(role="'model'", parts=_list(text(_TEXT), call)), _json(role="'user'", parts=_list(back, text(_TEXT)))
    opening = "concat('Conversation ', cast(conv_id as string))"
    body = _json(systemInstruction=raw(_json(parts=_list(text(opening)))), contents=raw("concat('[', items, ']')"))
    used = _json(promptTokenCount=_IN, candidatesTokenCount="turn", thoughtsTokenCount="2", cachedContentTokenCount="7")
    chunk = lambda *parts, **more: _json(candidates=_list(_json(content=raw(_json(parts=_list(*parts))))), **more)
    first = chunk(text(_THINK, thought="true"), text(f"substring({_TEXT}, 1, 3)"))
    last = chunk(text(f"substring({_TEXT}, 4)"), call, usageMetadata=raw(used), modelVersion="'gemini-2.5-pro'")
    return mine, other, body, f"concat('data: ', {first}, '\\n\\ndata: ', {last}, '\\n\\n')"


def _stream() -> tuple[str, str, str, str]:
    call = _json(type="'tool_use'", id=_ID, name="'shell'", input=raw(_ARGS))
    text = _json(type="'text'", text=_TEXT)
    back = _json(type="'tool_result'", tool_use_id=_BEFORE, content=_OUT)
    mine, other = _json(role="'assistant'", content=_list(text, call)), _json(role="'user'", content=_list(back, text))
    body = _json(model="'claude-sonnet-4'", system="concat('Conversation ', cast(conv_id as string))", messages=raw("concat('[', items, ']')"))
    used = _json(input_tokens=_IN, cache_read_input_tokens="7", output_tokens="0")
    opened = lambda at, **block: ("content_block_start", _json(type="'content_block_start'", index=at, content_block=raw(_json(**block))))
    grown = lambda at, **delta: ("content_block_delta", _json(type="'content_block_delta'", index=at, delta=raw(_json(**delta))))
    events = _events(
        ("message_start", _json(type="'message_start'", message=raw(_json(model="'claude-sonnet-4'", usage=raw(used))))),
        opened("0", type="'thinking'", thinking="''"), grown("0", type="'thinking_delta'", thinking=_THINK),
        opened("1", type="'text'", text="''"), grown("1", type="'text_delta'", text=f"substring({_TEXT}, 1, 3)"), grown("1", type="'text_delta'", text=f"substring({_TEXT}, 4)"),
        opened("2", type="'tool_use'", id=_ID, name="'shell'"), grown("2", type="'input_json_delta'", partial_json="'{\"n\"'"), grown("2", type="'input_json_delta'", partial_json="concat(':', cast(turn as string), '}')"),
        ("message_delta", _json(type="'message_delta'", delta=raw(_json(stop_reason="'tool_use'")), usage=raw(_json(output_tokens=_MADE)))),
    )
    return mine, other, body, events


FORMATS = {"codex": (_codex, "https://host/v1/responses"), "gemini": (_gemini, "https://host/v1beta/models/gemini-2.5-pro:streamGenerateContent"), "stream": (_stream, "https://host/v1/messages")}


def format_steps(spark, sf_dir, kind: str):
    """Steps of logs that hold conversations in one wire format, answers streamed. Each assistant turn thinks, speaks and
    calls a tool; each other turn brings a result for the call that the turn before it would have made, and speaks."""
    make, url = FORMATS[kind]
    mine, other, body, stream = make()
    c = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr("concat('T', cast(turn as string), ' ', coalesce(text, ''))").alias(_TEXT))
    c = c.withColumn("item", F.expr(f"CASE WHEN role = 'assistant' THEN {mine} ELSE {other} END"))
    before = "over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)"
    c = c.withColumn("items", F.expr(f"array_join(collect_list(item) {before}, ',')")).filter("role = 'assistant'")
    at = "cast(1700000000 + conv_id * 1000 + turn as string)"
    text = f"""concat('{{"request":{{"timestamp":', {at}, ',"method":"POST","url":"{url}","body":', {body}, '}},"response":{{"timestamp":', {at}, '.5,"status_code":200,"body_raw":', substring(to_json(array(streamed)), 2, length(to_json(array(streamed))) - 2), '}}}}')"""
    c = c.withColumn("streamed", F.expr(stream))
    rows = c.select(F.expr("concat('log', cast(conv_id as string))").alias("source_path"), F.col("turn").alias("pair_index"), F.expr(text).alias("raw"))
    steps = trajectory.steps(trajectory.conversations(decoded(rows)))
    calls = F.array_join(F.transform("tool_calls", lambda t: F.concat_ws(" ", t["id"], t["name"], t["args_json"])), ",")
    outputs = F.array_join(F.transform("observations", lambda o: o["content"]), ",")
    used = [F.col(f"usage.{n}").alias(n) for n in ("prompt_tokens", "completion_tokens", "cache_read_tokens", "reasoning_tokens")]
    return steps.select("source_path", "step_index", "role", "message", "reasoning", F.coalesce(calls, F.lit("")).alias("calls"), F.coalesce(outputs, F.lit("")).alias("outputs"), *used)


def _format_sql(thought: str) -> str:
    return f"""WITH c AS (SELECT conv_id, turn, role, 'T' || turn || ' ' || coalesce(text, '') AS text, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_turn FROM conversations),
steps AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS step_index, role = 'assistant' AS made, text FROM c WHERE role = 'assistant' OR turn < last_turn),
results AS (SELECT conv_id, turn, (SELECT max(s.turn) FROM steps s WHERE s.made AND s.conv_id = c.conv_id AND s.turn < c.turn) AS made_at FROM c WHERE role <> 'assistant' AND turn < last_turn),
seen AS (SELECT conv_id, made_at AS turn, string_agg('out' || turn, ',' ORDER BY turn) AS outputs FROM results WHERE made_at IS NOT NULL GROUP BY conv_id, made_at)
SELECT 'log' || conv_id AS source_path, step_index, CASE WHEN made THEN 'agent' ELSE 'user' END AS role, text AS message, CASE WHEN made THEN 'think' || turn ELSE '' END AS reasoning,
  CASE WHEN made THEN 'call' || turn || ' shell {{"n":' || turn || '}}' ELSE '' END AS calls, coalesce(outputs, '') AS outputs,
  CASE WHEN made THEN (10 * turn + 1)::BIGINT END AS prompt_tokens, CASE WHEN made THEN (turn + 2)::BIGINT END AS completion_tokens, CASE WHEN made THEN 7::BIGINT END AS cache_read_tokens, CASE WHEN made THEN {thought} END AS reasoning_tokens
FROM steps LEFT JOIN seen USING (conv_id, turn)"""


for _kind in FORMATS:
    query(f"traj_{_kind}_steps", _format_sql("NULL::BIGINT" if _kind == "stream" else "2::BIGINT"))(lambda spark, sf_dir, kind=_kind: format_steps(spark, sf_dir, kind))
