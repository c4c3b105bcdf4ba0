"""Comparison of two runs as tables: models, prompt, tools, shape and calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.functions import prices as P
from wirespan.operators import diff, trajectory


@dataclass
class Run:
    """Turns and steps of a run, and its tools (name, definition): the largest set that a request brought."""

    turns: DataFrame
    steps: DataFrame
    tools: DataFrame


def run_of(records: DataFrame) -> Run:
    """The run that decoded pairs make."""
    turns = trajectory.conversations(records)
    sets = turns.filter("tools_json is not null").select(F.from_json("tools_json", "array<string>").alias("tools"), F.col("pair_index").alias("seq"))
    best = diff.representative_tools(sets).select(F.explode("tools").alias("definition"))
    name = F.coalesce(F.get_json_object("definition", "$.name"), F.get_json_object("definition", "$.function.name"), F.get_json_object("definition", "$.type"))
    return Run(turns, trajectory.steps(turns), best.select(name.alias("name"), "definition").filter("name is not null"))


def _shape(run: Run, prices: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).alias(c) for c in P.COUNTERS]
    counts = run.steps.agg(
        F.count("*").alias("steps"), F.count_if(F.col("role") == "user").alias("user_steps"), F.count_if(F.col("role") == "agent").alias("agent_steps"),
        F.coalesce(F.sum(F.size("tool_calls")), F.lit(0)).alias("tool_calls"), *sums, F.sum("usage.reasoning_tokens").alias("reasoning_tokens"),
    )
    heads = trajectory.session_rows(run.turns, run.steps, prices).agg(F.count("*").alias("trajectories"), F.sum("cost_usd").alias("cost_usd"))
    return counts.crossJoin(heads)  # a row each


def compare(a: Run, b: Run, prices: DataFrame | None = None) -> dict[str, DataFrame]:
    """What two runs differ in: models (models_a, models_b, changed), prompt (line, op, text), tools (name, change), shape
    (metric, a, b, delta) and calls (name, n_a, n_b, delta). prices: a price table, or None for the built-in one."""
    prices = P.price_table(a.turns.sparkSession) if prices is None else prices
    requests = [r.turns.withColumns({"seq": F.col("pair_index"), "run": F.lit(1), "prompt": F.col("diff_prompt")}) for r in (a, b)]
    left, right = (diff.representative_prompt(r) for r in requests)
    calls = [r.steps.select(F.explode("tool_calls").alias("c")).groupBy(F.col("c.name").alias("name")).agg(F.count("*").alias("n")) for r in (a, b)]
    return {
        "models": diff.model_diff(*(diff.models_in_order(r, ["run"]) for r in requests)),
        "prompt": diff.text_diffs(left.select(F.lit(1).alias("id"), F.col("prompt").alias("a")).crossJoin(right.select(F.col("prompt").alias("b")))).drop("id"),
        "tools": diff.tools_diff(a.tools, b.tools),
        "shape": diff.run_shapes(_shape(a, prices), _shape(b, prices)),
        "calls": diff.histogram_diff(*calls),
    }


def listed(tables: dict[str, DataFrame]) -> DataFrame:
    """section, name, a, b of everything in compare's tables but the prompt's common lines, in order of section, then of line
    or name."""
    nothing = F.lit(None)
    line = F.lpad(F.col("line").cast("string"), 9, "0")
    parts = (
        ("model", "models", F.lit(""), F.lit("models"), F.array_join("models_a", ","), F.array_join("models_b", ",")),
        ("prompt", "prompt", line, F.concat(F.col("op"), F.lit(" "), F.col("line")), F.when(F.col("op") == "del", F.col("text")), F.when(F.col("op") == "add", F.col("text"))),
        ("tools", "tools", F.col("name"), F.col("name"), F.col("change"), nothing),
        ("shape", "shape", F.lit(""), F.col("metric"), F.col("a"), F.col("b")),
        ("calls", "calls", F.col("name"), F.col("name"), F.col("n_a"), F.col("n_b")),
    )
    out = None
    for i, (section, table, place, name, a, b) in enumerate(parts):
        rows = tables[table].filter("op <> 'context'") if table == "prompt" else tables[table]
        rows = rows.select(F.lit(i).alias("i"), place.alias("place"), F.lit(section).alias("section"), name.alias("name"), a.cast("string").alias("a"), b.cast("string").alias("b"))
        out = rows if out is None else out.unionAll(rows)
    return out.orderBy("i", "place", "name").drop("i", "place")
