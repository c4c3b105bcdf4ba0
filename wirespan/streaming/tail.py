"""A stream of the lines appended to logs, by byte offset, and of the steps that they add.

Spark's file streams take a file once and see nothing appended later, so the source keeps offsets of its own: the sizes of
the logs, which the driver asks for and no more. A batch has a partition for each log that grew, and an executor reads it.
A line belongs to the batch in which it ends, so one without an end waits for the rest; a log shorter than its offset was
replaced and is read from its start, its pairs after those before.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from wirespan.operators.trajectory import KEY
from wirespan.sources import logs
from wirespan.sources.wire import decoded
from wirespan.streaming import state

SCHEMA = "source_path string, pair_index long, ts double, raw string"
#: Bytes read at once, also when looking back for the start of a line.
READ_BYTES = 1 << 20


@dataclass
class Range(InputPartition):
    """The bytes of one log from start to end."""

    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def line_start(f, at: int) -> int:
    """Where the line begins that the byte before at belongs to, or at itself if that byte ends a line."""
    while at > 0:
        size = min(READ_BYTES, at)
        f.seek(at - size)
        found = f.read(size).rfind(b"\n")
        if found >= 0:
            return at - size + found + 1
        at -= size
    return 0


def ended_lines(path: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(byte place, text) of the lines of path whose end lies in the range; one is held at a time. A log that can't be read
    gives none."""
    try:
        f = open(path, "rb")
    except OSError:
        return
    with f:
        at = line_start(f, start)
        f.seek(at)
        while at < end:
            line = f.readline()
            if not line.endswith(b"\n") or at + len(line) > end:
                return
            yield at, line.decode("utf-8", "replace").strip()
            at += len(line)


def as_rows(path: str, found: Iterator[tuple[int, str]]) -> Iterator[tuple]:
    for at, text in found:
        try:
            pair = json.loads(text)
        except ValueError:
            continue
        ts = (pair.get("request") or {}).get("timestamp") if isinstance(pair, dict) else None
        yield path, at, float(ts) if isinstance(ts, (int, float)) else 0.0, text


class TailReader(DataSourceStreamReader):
    """Offsets are the sizes of the logs; pair_index is the byte place of the pair, which grows with the log."""

    def __init__(self, options: dict):
        self.roots = options["path"].split(",")

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        sizes = {}
        for path in logs.discover(self.roots):
            try:
                sizes[path] = os.path.getsize(path)
            except OSError:
                pass  # it has gone meanwhile
        return {"files": sizes}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        known = start["files"]
        begins = {path: known.get(path, 0) if known.get(path, 0) <= size else 0 for path, size in end["files"].items()}
        return [Range(path, begins[path], size) for path, size in end["files"].items() if size > begins[path]]

    def read(self, partition: Range) -> Iterator[tuple]:
        return as_rows(partition.path, ended_lines(partition.path, partition.start, partition.end))


class TailSource(DataSource):
    """spark.readStream.format("trace_tail").option("path", roots, comma between).load()"""

    @classmethod
    def name(cls) -> str:
        return "trace_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, roots: list[str]) -> DataFrame:
    """A streaming DataFrame of the pairs in the logs under roots and of those appended to them."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("trace_tail").option("path", ",".join(roots)).load()


def follow(spark: SparkSession, roots: list[str], folder: str, on_change: Callable[[DataFrame, int], None], interval: str = "250 milliseconds"):
    """Keeps the events (see state) of the logs under roots in folder, and after each batch that brought some calls
    on_change with them and the number of the batch. Returns the running query; with the same folder it goes on where it
    stopped. steps_so_far reads what it has kept."""

    def batch(rows: DataFrame, number: int) -> None:
        # A batch that runs again overwrites what it wrote.
        path = f"{folder}/events/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        brought = spark.read.schema(state.EVENT).parquet(path)
        if not brought.isEmpty():
            on_change(brought, number)

    key, provider = state.STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        found = state.events(decoded(tail(spark, roots)))
        return found.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=interval).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def steps_so_far(spark: SparkSession, folder: str, source_path: str | None = None, session_id: str | None = None) -> DataFrame:
    """The steps of everything that follow has kept in folder, or of one log or session of it, which is how a selected
    session is followed while others grow."""
    found = spark.read.schema(f"{state.EVENT}, batch long").parquet(f"{folder}/events")
    if source_path is not None:
        found = found.filter(F.col("source_path") == source_path)
    if session_id is not None:
        found = found.filter(F.col("session_id") == session_id)
    return state.steps_of(found).orderBy(*KEY, "step_index")
