"""Table functions that SQL text can call with LATERAL, once register(spark) has run."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from wirespan.operators.diff import diff_lines
from wirespan.operators.redact import location, walk


class WalkStrings:
    """walk_strings(json): text, path, role, location of every string value; no rows for null or what is no JSON."""

    def eval(self, raw: str) -> Iterator[tuple]:
        try:
            value = json.loads(raw)
        except (TypeError, ValueError):
            return
        for text, path, role in walk(value):
            yield text, "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path), role, location(path, role)


class DiffLines:
    """diff_lines(a, b): line (from 0), op, text of each line of the diff; a null text has no lines."""

    def eval(self, a: str, b: str) -> Iterator[tuple]:
        for line, (op, text) in enumerate(diff_lines(a or "", b or "")):
            yield line, op, text


def register(spark: SparkSession) -> None:
    """Both functions, run over Arrow batches."""
    spark.udtf.register("walk_strings", udtf(WalkStrings, returnType="text string, path string, role string, location string", useArrow=True))
    spark.udtf.register("diff_lines", udtf(DiffLines, returnType="line int, op string, text string", useArrow=True))
