"""Structural comparison of two runs: models, prompts, tools, shape, and lines of text."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def models_in_order(requests: DataFrame, by: list[str]) -> DataFrame:
    """by, models in order of first use, and whether the run changed its model."""
    first = requests.filter("model is not null").groupBy(*by, "model").agg(F.min("seq").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"])
    return first.groupBy(*by).agg(ordered.alias("models")).withColumn("swapped", F.size("models") > 1)


def model_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Models of two runs (models, swapped; one row each) and whether they differ."""
    left, right = (x.select(F.col("models").alias(f"models_{n}"), F.col("swapped").alias(f"swapped_{n}")) for x, n in ((a, "a"), (b, "b")))
    return left.crossJoin(right).withColumn("changed", F.col("models_a") != F.col("models_b"))


def representative_prompt(requests: DataFrame) -> DataFrame:
    return requests.filter("prompt <> ''").agg(F.min_by("prompt", "seq").alias("prompt"))


def representative_tools(requests: DataFrame) -> DataFrame:
    """The largest set of tools, the earliest of equals."""
    return requests.agg(F.max_by("tools", F.struct(F.size("tools"), -F.col("seq"))).alias("tools"))


def tools_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """name and change (added, removed, changed or same) of the tools (name, definition) of two runs."""
    rows = a.select("name", F.col("definition").alias("a")).join(b.select("name", F.col("definition").alias("b")), "name", "full")
    return rows.select("name", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("change"))


def histogram_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, n_a, n_b, delta of two histograms (name, n)."""
    rows = a.select("name", F.col("n").alias("n_a")).join(b.select("name", F.col("n").alias("n_b")), "name", "full")
    rows = rows.select("name", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b")))
    return rows.withColumn("delta", F.col("n_b") - F.col("n_a"))


def shape_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b, delta of two one-row tables with the same numeric columns."""
    names = a.columns
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"a.{c}").cast("double").alias("a"), F.col(f"b.{c}").cast("double").alias("b")) for c in names))
    rows = a.select(F.struct(*names).alias("a")).crossJoin(b.select(F.struct(*names).alias("b"))).select(F.explode(pairs).alias("p")).select("p.*")
    return rows.withColumn("delta", F.col("b") - F.col("a"))


def run_shapes(a: DataFrame, b: DataFrame) -> DataFrame:
    """shape_diff of two runs; a metric that neither has (reasoning tokens, cost) is left out, one that one has is 0 in the
    other."""
    rows = shape_diff(a, b).filter("a is not null or b is not null")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("a", "b")})
    return rows.withColumn("delta", F.col("b") - F.col("a"))


def _suffix_rows(x: list[str], y: list[str]):
    """Rows of the table of common subsequences of suffixes, as bits, by their number; asked for in rising order.

    Bit len(y) - 1 - j of row i says whether x[i:] and y[j:] have a longer one than x[i:] and y[j + 1:] (Hyyro's
    bit-parallel recurrence). About sqrt(len(x)) rows are held; those between are made again.
    """
    m = len(y)
    every = (1 << m) - 1
    places: dict[str, int] = {}
    for j, t in enumerate(y):
        places.setdefault(t, 0)
        places[t] |= 1 << (m - 1 - j)

    def above(same: int, i: int) -> int:
        u = same & places.get(x[i], 0)
        return ((same + u) | (same - u)) & every

    step = math.isqrt(len(x)) + 1
    row, kept = every, {len(x): every}  # zero bits of a row mark the steps
    for i in reversed(range(len(x))):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row
    held: dict[int, int] = {}

    def at(i: int) -> int:
        if i in kept:
            return every ^ kept[i]
        if i not in held:
            held.clear()
            end = min((i // step + 1) * step, len(x))
            below = kept[end]
            for k in reversed(range(i, end)):
                below = held[k] = above(below, k)
        return every ^ held[i]

    return at


def diff_lines(a: str, b: str, cells: int | None = None) -> list[tuple[str, str]]:
    """('context', 'del' or 'add', line) of a shortest edit by longest common subsequence; deletions first on ties.

    An empty text has no lines. With cells, as a dashboard has it, texts that differ over more pairs of lines than that count as changed whole.
    Common lines at the start are set aside first, and for that count those at the end.
    """
    x, y = (t.split("\n") if t else [] for t in (a, b))
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    if cells is not None:
        tail = 0
        while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        if (len(x) - head - tail) * (len(y) - head - tail) > cells:
            changed = [("del", t) for t in x[head : len(x) - tail]] + [("add", t) for t in y[head : len(y) - tail]]
            return [("context", t) for t in x[:head]] + changed + [("context", t) for t in x[len(x) - tail :]]
    ops = [("context", t) for t in x[:head]]
    x, y = x[head:], y[head:]
    row = _suffix_rows(x, y)
    n, m = len(x), len(y)
    i = j = 0
    # Longest common subsequences of x[i:] and y[j:], and of x[i + 1:] and y[j:]; now and then are their rows.
    count = lambda bits: (bits & ((1 << (m - j)) - 1)).bit_count()
    now, then = row(0), row(1) if n else 0
    size, size_then = count(now), count(then)
    while i < n and j < m:
        if x[i] != y[j] and size_then < size:
            # Without y[j] it is as long: were it shorter, x[i] could go instead.
            ops.append(("add", y[j]))
            size -= now >> (m - 1 - j) & 1
            size_then -= then >> (m - 1 - j) & 1
            j += 1
            continue
        if x[i] == y[j]:
            ops.append(("context", x[i]))
            j += 1
        else:
            ops.append(("del", x[i]))
        i += 1
        now, then = then, row(i + 1) if i < n else 0
        size, size_then = count(now), count(then)
    return ops + [("del", t) for t in x[i:]] + [("add", t) for t in y[j:]]


def text_diffs(pairs: DataFrame) -> DataFrame:
    """id, line, op, text of each line of the diff of every pair (id long, a, b)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ops = diff_lines(a or "", b or "")
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(ops), pa.int64()), pa.array(range(len(ops)), pa.int32()), pa.array([o for o, _ in ops], pa.string()), pa.array([t for _, t in ops], pa.string())], ["id", "line", "op", "text"])

    return pairs.select(F.col("id").cast("long"), "a", "b").mapInArrow(run, "id long, line int, op string, text string")


def folded_context(lines: DataFrame, around: int = 2) -> DataFrame:
    """Lines of diffs that are changes or within `around` lines of one."""
    near = F.max((F.col("op") != "context").cast("int"))
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("line").rowsBetween(-around, around)
    return lines.withColumn("near", near.over(w)).filter("near = 1").drop("near")
