"""Model prices: the built-in table, overlays, conversion of a public price list, and longest-prefix resolution.

Prices are whole micro-dollars per million tokens, so costs add up exactly as integers and are divided once.
"""

from __future__ import annotations

import json
import math
import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: US dollars per million tokens for input, output, cache write, cache read.
BUILT_IN = {
    "claude-opus-4": (15, 75, 18.75, 1.5),
    "claude-opus-4-1": (15, 75, 18.75, 1.5),
    "claude-sonnet-4": (3, 15, 3.75, 0.3),
    "claude-3-7-sonnet": (3, 15, 3.75, 0.3),
    "claude-3-5-sonnet": (3, 15, 3.75, 0.3),
    "claude-3-5-haiku": (0.8, 4, 1, 0.08),
    "claude-3-haiku": (0.25, 1.25, 0.3, 0.03),
    "claude-3-opus": (15, 75, 18.75, 1.5),
    "gpt-5.1": (1.25, 10, 1.25, 0.125),
    "gpt-5": (1.25, 10, 1.25, 0.125),
    "gpt-4.1": (2, 8, 2, 0.5),
    "gpt-4o": (2.5, 10, 2.5, 1.25),
    "gpt-4o-mini": (0.15, 0.6, 0.15, 0.075),
    "o3": (2, 8, 2, 0.5),
    "o4-mini": (1.1, 4.4, 1.1, 0.275),
}

COUNTERS = ("prompt_tokens", "completion_tokens", "cache_creation_tokens", "cache_read_tokens")
PRICES = ("p_in", "p_out", "p_write", "p_read")
SCHEMA = "key string, p_in long, p_out long, p_write long, p_read long"

Prices = dict[str, tuple[float, float, float, float]]


def price_table(spark: SparkSession, prices: Prices | None = None) -> DataFrame:
    """key and four whole prices in micro-dollars per million tokens."""
    rows = [(key, *(round(p * 1_000_000) for p in own)) for key, own in (BUILT_IN if prices is None else prices).items()]
    return spark.createDataFrame(rows, SCHEMA)


def overlaid(*tables: Prices) -> Prices:
    """One table in which later tables win."""
    out: Prices = {}
    for table in tables:
        out |= table
    return out


def converted(listing: dict) -> Prices:
    """A price table from a public per-token listing (model to *_cost_per_token numbers).

    Entries without numbers, or free both ways, are left out, as is the sample entry; missing cache prices are the
    input price. Keys with a provider prefix also count by their last part, where no plain key has it.
    """
    plain, prefixed = {}, {}
    for key, entry in listing.items():
        if key == "sample_spec" or not isinstance(entry, dict):
            continue
        number = lambda name: v if isinstance(v := entry.get(name), (int, float)) and not isinstance(v, bool) and math.isfinite(v) else None
        given, made = number("input_cost_per_token"), number("output_cost_per_token")
        if given is None or made is None or given <= 0 and made <= 0:
            continue
        write, read = number("cache_creation_input_token_cost"), number("cache_read_input_token_cost")
        price = tuple(round(x * 1e6, 9) for x in (given, made, given if write is None else write, given if read is None else read))
        (prefixed if "/" in key else plain)[key.rsplit("/", 1)[-1]] = price
    return prefixed | plain


def loaded(cache: str, fetch=None, max_age_s: float = 7 * 86400, now: float | None = None) -> tuple[Prices, str]:
    """Prices over the built-in ones and where they come from: fresh cache, network (fetch()), stale cache or built in."""
    now = time.time() if now is None else now
    cached = None
    try:
        with open(cache, encoding="utf-8") as f:
            cached = json.load(f)
        if not isinstance(cached.get("prices"), dict) or not cached["prices"]:
            cached = None
    except (OSError, ValueError, AttributeError):
        pass
    table = lambda prices: overlaid(BUILT_IN, {k: tuple(v) for k, v in prices.items()})
    if cached and now - cached.get("fetched_at", 0) < max_age_s:
        return table(cached["prices"]), "cache"
    if fetch:
        try:
            prices = converted(fetch())
            if prices:
                os.makedirs(os.path.dirname(cache) or ".", exist_ok=True)
                with open(cache, "w", encoding="utf-8") as f:
                    json.dump({"fetched_at": now, "prices": prices}, f)
                return table(prices), "network"
        except (OSError, ValueError):
            pass
    return (table(cached["prices"]), "stale cache") if cached else (dict(BUILT_IN), "built in")


def resolved(models: DataFrame, prices: DataFrame) -> DataFrame:
    """model, key and prices (null if none) of each distinct model: the exact id, else its lower case, else the longest
    key that begins it. Each distinct model is unfolded into its beginnings, which meet the keys in an equal join."""
    distinct = models.select("model").filter("model is not null").distinct()
    begins = distinct.select("model", F.explode(F.sequence(F.lit(0), F.length("model"))).alias("n")).select("model", F.lower("model").substr(F.lit(1), F.col("n")).alias("begins"))
    rank = F.when(F.col("model") == F.col("key"), F.lit(1_000_000)).when(F.lower("model") == F.col("key"), F.lit(900_000)).otherwise(F.length("key"))
    best = begins.join(prices, F.col("begins") == F.lower("key"), "left").groupBy("model").agg(F.max_by(F.struct("key", *PRICES), F.struct(rank, "key")).alias("best"))
    return best.select("model", "best.*")


def micro_cost() -> Column:
    """Cost in millionths of a micro-dollar, null for models without a price."""
    return sum((F.col(n) * F.col(p) for n, p in zip(COUNTERS[1:], PRICES[1:], strict=True)), F.col(COUNTERS[0]) * F.col(PRICES[0]))


def priced(events: DataFrame, prices: DataFrame) -> DataFrame:
    """events (model and four counters) with micro_cost; usd() of its sums gives dollars."""
    return events.join(resolved(events, prices), "model", "left").withColumn("micro_cost", micro_cost()).drop("key", *PRICES)


def usd(micro: Column) -> Column:
    return micro.cast("double") / F.lit(1e12)


def cache_hit_rate(prompt: Column, creation: Column, read: Column) -> Column:
    total = prompt + creation + read
    return F.when(total > 0, read.cast("double") / total.cast("double")).otherwise(F.lit(0.0))
