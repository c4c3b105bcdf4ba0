"""What reports and pages are fed with: digests, headlines, short numbers, calendars, histograms, stats files."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirespan.functions.prices import COUNTERS
from wirespan.functions.times import local_time
from wirespan.operators.trajectory import KEY

#: Most characters of a message, of a call's arguments and of an output in a digest, and of a digest.
MESSAGE, ARGS, OUTPUT, DIGEST = 600, 200, 200, 16_000
#: Arguments that head a tool call, in order.
HEADLINES = ("file_path", "path", "notebook_path", "pattern", "url", "command", "description")


def clipped(text: Column, most: int) -> Column:
    """White space runs as one space; longer text is cut and marked with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def digests(steps: DataFrame, heads: DataFrame) -> DataFrame:
    """source_path and digest: what happened in each log, a line a message, call or output; a long one keeps its first
    60 % and last 35 %. steps: of trajectory.steps; heads: KEY, agent, model, at (order of conversations in their log)."""
    call = lambda c: F.concat(F.lit("  TOOL "), c["name"], F.lit("("), clipped(c["args_json"], ARGS), F.lit(")"))
    output = lambda o: F.when(clipped(o["content"], OUTPUT) != "", F.concat(F.lit("    -> "), clipped(o["content"], OUTPUT)))
    said = clipped(F.col("message"), MESSAGE)
    spoken = F.when(said != "", F.concat(F.when(F.col("role") == "agent", "AGENT: ").otherwise("USER: "), said))
    none = F.array().cast("array<string>")
    parts = F.concat(F.array(spoken), F.coalesce(F.transform("tool_calls", call), none), F.coalesce(F.transform("observations", output), none))
    lines = steps.select(*KEY, "step_index", F.array_join(parts, "\n").alias("line")).filter("line <> ''")
    body = lines.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_index", "line"))), lambda x: x["line"]), "\n").alias("body"))
    runs = heads.join(body, KEY, "left").groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("at", "agent", "model", "body"))).alias("runs"))
    number = lambda i: F.when(F.size("runs") > 1, F.concat(F.lit(" "), (i + 1).cast("string"))).otherwise(F.lit(""))
    each = F.transform("runs", lambda r, i: F.concat(F.lit("## Session"), number(i), F.lit(" — "), r["agent"], F.lit(" ("), r["model"], F.lit(")"), F.when(r["body"].isNotNull(), F.concat(F.lit("\n"), r["body"])).otherwise(F.lit(""))))
    whole = F.array_join(each, "\n\n")
    cut = F.concat(F.substring(whole, 1, DIGEST * 60 // 100), F.lit("\n\n…[trajectory truncated]…\n\n"), F.right(whole, F.lit(DIGEST * 35 // 100)))
    return runs.select("source_path", F.when(F.length(whole) > DIGEST, cut).otherwise(whole).alias("digest"))


def headline(args: Column) -> Column:
    """The first telling argument of a tool call (JSON text), 96 characters at most."""
    found = F.coalesce(*(F.nullif(F.get_json_object(args, f"$.{name}"), F.lit("")) for name in HEADLINES), F.lit(""))
    return F.when(F.length(found) > 96, F.concat(F.substring(found, 1, 95), F.lit("…"))).otherwise(found)


def call_kind(args: Column) -> Column:
    """'edit' for arguments with an old and a new string, 'command' for those with a command, else 'other'."""
    has = lambda name: F.get_json_object(args, f"$.{name}").isNotNull()
    return F.when(has("old_string") & has("new_string"), "edit").when(has("command"), "command").otherwise("other")


def step_kind(role: Column, tools: Column, observation: Column) -> Column:
    """What a list shows a step as: user, tool, output, agent or system."""
    return F.when(role == "user", "user").when(F.size(tools) > 0, "tool").when(observation != "", "output").otherwise(role)


def short_tokens(n: Column) -> Column:
    scaled = lambda by, letter, whole: F.concat(F.format_string("%.1f", n / by), F.lit(letter)) if not whole else F.concat(F.format_string("%.0f", n / by), F.lit(letter))
    return F.when(n >= 10_000_000, scaled(1e6, "M", True)).when(n >= 1_000_000, scaled(1e6, "M", False)).when(n >= 100_000, scaled(1e3, "K", True)).when(n >= 1000, scaled(1e3, "K", False)).otherwise(n.cast("string"))


def short_cost(usd: Column, unpriced: Column) -> Column:
    shown = F.when(usd >= 100, F.format_string("$%.0f", usd)).otherwise(F.format_string("$%.2f", usd))
    return F.when(usd.isNull(), "—").otherwise(F.concat(shown, F.when(unpriced, "+").otherwise("")))


def _minutes(ms: Column, seconds: Column, apart: str) -> Column:
    """'5m 3s' or '2h 5m' of milliseconds from a minute on; seconds: those beyond whole minutes."""
    minutes = F.floor(ms / 60_000)
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit(f"h{apart}"), (minutes % 60).cast("string"), F.lit("m"))
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(f"m{apart}"), seconds.cast("string"), F.lit("s"))).otherwise(hours)


def report_duration(ms: Column) -> Column:
    """Milliseconds as a report shows them: 0s, 3.4s, 12s, 5m 3s, 2h 5m."""
    seconds = F.when(ms < 10_000, F.format_string("%.1fs", ms / 1000)).otherwise(F.format_string("%.0fs", ms / 1000))
    return F.when(ms <= 0, "0s").when(ms < 60_000, seconds).otherwise(_minutes(ms, F.floor(ms / 1000 % 60 + 0.5), " "))


def request_duration(ms: Column) -> Column:
    """Milliseconds as a list of requests shows them: a dash for none, 850ms, 3.4s, 5m 3s, 2h 5m."""
    seconds = F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms / 1000))
    return F.when(ms.isNull(), "—").when(ms < 60_000, seconds).otherwise(_minutes(ms, F.floor(ms / 1000 % 60 + 0.5), " "))


def list_duration(ms: Column) -> Column:
    """Milliseconds as a list of sessions shows them, in whole seconds: a dash for none, 3s, 5m3s, 5m, 2h5m."""
    whole = F.floor(ms / 1000 + 0.5)
    shown = F.regexp_replace(_minutes(whole * 1000, whole % 60, ""), "m0s$", "m")
    return F.when(F.coalesce(ms, F.lit(0)) <= 0, "—").when(whole < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(shown)


def minute_of(seconds: Column, tz: str = "UTC") -> Column:
    """Epoch seconds as 2024-01-31 09:05, a dash for none."""
    return F.when(seconds > 0, F.date_format(local_time(seconds, tz), "yyyy-MM-dd HH:mm")).otherwise(F.lit("—"))


def calendar(trend: DataFrame, last: str, days: int = 182) -> DataFrame:
    """day, week, weekday (0 is Sunday), cost_usd, opacity of a grid of days up to last that starts on a Sunday."""
    spark = trend.sparkSession
    start = F.date_sub(F.lit(last).cast("date"), days - 1)
    first = F.next_day(F.date_sub(start, 7), "Sun")
    grid = spark.range(1).select(first.alias("first"), F.explode(F.sequence(first, F.lit(last).cast("date"))).alias("d"))
    grid = grid.select(F.col("d").cast("string").alias("day"), F.floor(F.datediff("d", "first") / 7).cast("int").alias("week"), (F.dayofweek("d") - 1).alias("weekday"))
    most = trend.agg(F.max("cost_usd").alias("most"))
    rows = grid.join(trend.select("day", "cost_usd"), "day", "left").crossJoin(F.broadcast(most))
    opacity = F.when(F.col("cost_usd") > 0, F.round(0.22 + 0.78 * F.sqrt(F.col("cost_usd") / F.col("most")), 2))
    return rows.select("day", "week", "weekday", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), opacity.alias("opacity"))


def treemap(areas: DataFrame, label: str, value: str, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """label, x, y, w, h of a rectangle for each positive value, in proportion, tiling a field of that size.

    Squarified: largest first (ties by label), values fill a row along the shorter side of what is left of the field until
    one more would make its worst proportion worse. The rows that a chart shows are folded in one row, as each depends on
    those before.
    """
    shown = areas.filter(F.col(value) > 0)
    whole = shown.agg(F.sum(F.col(value).cast("double")).alias("whole"), F.array_sort(F.collect_list(F.struct((-F.col(value).cast("double")).alias("v"), F.col(label).cast("string").alias("label")))).alias("items"))
    items = F.transform("items", lambda i: F.struct(i["label"].alias("label"), (-i["v"] * (width * height) / F.col("whole")).alias("a")))
    cell = "array<struct<label:string,a:double,before:double>>"
    out = "array<struct<label:string,x:double,y:double,w:double,h:double>>"
    number = lambda v: F.lit(float(v))

    def laid(t: Column) -> Column:
        """The rectangles of a row, after those laid before."""
        across = t["w"] < t["h"]
        thick = t["sum"] / F.least(t["w"], t["h"])
        placed = F.transform(t["row"], lambda c: F.struct(
            c["label"].alias("label"), (t["x"] + F.when(across, c["before"] / thick).otherwise(number(0))).alias("x"), (t["y"] + F.when(across, number(0)).otherwise(c["before"] / thick)).alias("y"),
            F.when(across, c["a"] / thick).otherwise(thick).alias("w"), F.when(across, thick).otherwise(c["a"] / thick).alias("h"),
        ))
        return F.concat(t["out"], placed)

    def step(t: Column, i: Column) -> Column:
        side, total = F.least(t["w"], t["h"]), t["sum"] + i["a"]
        worst = lambda s, low, high: F.greatest(side * side * high / (s * s), s * s / (side * side * low))
        closes = (F.size(t["row"]) > 0) & (worst(total, F.least(t["low"], i["a"]), F.greatest(t["high"], i["a"])) > worst(t["sum"], t["low"], t["high"]))
        across, thick = t["w"] < t["h"], t["sum"] / side
        pick = lambda new, old: F.when(closes, new).otherwise(old)
        before = pick(number(0), t["sum"])
        return F.struct(
            pick(t["x"] + F.when(across, number(0)).otherwise(thick), t["x"]).alias("x"), pick(t["y"] + F.when(across, thick).otherwise(number(0)), t["y"]).alias("y"),
            pick(t["w"] - F.when(across, number(0)).otherwise(thick), t["w"]).alias("w"), pick(t["h"] - F.when(across, thick).otherwise(number(0)), t["h"]).alias("h"),
            F.concat(pick(F.array().cast(cell), t["row"]), F.array(F.struct(i["label"].alias("label"), i["a"].alias("a"), before.alias("before")))).alias("row"), (before + i["a"]).alias("sum"),
            pick(i["a"], F.least(t["low"], i["a"])).alias("low"), pick(i["a"], F.greatest(t["high"], i["a"])).alias("high"), pick(laid(t), t["out"]).alias("out"),
        )

    start = F.struct(number(0).alias("x"), number(0).alias("y"), number(width).alias("w"), number(height).alias("h"), F.array().cast(cell).alias("row"), number(0).alias("sum"), number(math.inf).alias("low"), number(0).alias("high"), F.array().cast(out).alias("out"))
    return whole.select(F.inline(F.aggregate(items, start, step, laid)))


def histogram_text(histogram: Column) -> Column:
    """'name×n, ...' of a map of counts, most first."""
    ordered = F.array_sort(F.transform(F.map_entries(histogram), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    return F.array_join(F.transform(ordered, lambda e: F.concat(e["k"], F.lit("×"), (-e["n"]).cast("string"))), ", ")


def histogram_of(text: Column) -> Column:
    """A map of counts from its JSON text; an empty one from anything else."""
    return F.coalesce(F.from_json(text, "map<string,bigint>"), F.create_map().cast("map<string,bigint>"))


def sorted_json(text: str) -> str:
    """JSON text with sorted keys and two spaces of indent."""
    return json.dumps(json.loads(text), sort_keys=True, indent=2, ensure_ascii=False)


def summary(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """pair_count, trajectory_count and counters of a log, or of all logs, in one row."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    return turns.agg(F.count("*").alias("pair_count")).crossJoin(sessions.agg(F.count("*").alias("trajectory_count"), *sums, F.sum("reasoning_tokens").alias("reasoning_tokens")))


def write_stats(path: str, stats: DataFrame) -> str:
    """Writes the one row of stats beside a log, as indented JSON; returns the file's path."""
    out = path.removesuffix(".jsonl") + ".stats.json"
    os.makedirs(os.path.dirname(out) or ".", exist_ok=True)
    with open(out, "w", encoding="utf-8") as f:
        f.write(json.dumps(json.loads(stats.toJSON().first()), indent=2, ensure_ascii=False) + "\n")
    return out
