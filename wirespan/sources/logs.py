"""Log discovery, ordered reading of JSON lines, and which files changed since they were last read."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirespan.operators.redact import redact_pair

#: Folders that hold logs, and folders never searched.
TRACE_FOLDERS = (".claude-trace", ".codex-trace", ".gemini-trace")
SKIPPED = ("node_modules", ".git", ".cache", ".npm", ".pnpm-store", "Library", ".Trash")
DEPTH = 6

#: How each agent's calls are told by their paths.
PATHS = {"claude": ("prefix", "/v1/messages"), "codex": ("suffix", "/responses"), "gemini": ("part", "generatecontent")}


def discover(roots: Iterable[str], depth: int = DEPTH) -> list[str]:
    """Absolute paths of the .jsonl logs under roots, sorted: files named outright, and those in trace folders."""
    found: set[str] = set()

    def logs(folder: str) -> None:
        try:
            found.update(os.path.abspath(e.path) for e in os.scandir(folder) if e.is_file() and e.name.endswith(".jsonl"))
        except OSError:
            pass

    def search(folder: str, left: int) -> None:
        if os.path.basename(folder) in TRACE_FOLDERS:
            logs(folder)
            return
        try:
            inner = [e for e in os.scandir(folder) if e.is_dir(follow_symlinks=False)] if left >= 0 else []
        except OSError:
            return
        for e in inner:
            if e.name in TRACE_FOLDERS or e.name not in SKIPPED and not e.name.startswith("."):
                search(e.path, left - 1)

    for root in map(os.path.abspath, roots):
        if os.path.isfile(root) and root.endswith(".jsonl"):
            found.add(root)
        elif os.path.isdir(root):
            search(root, depth)
    return sorted(found)


def agent_calls(pairs: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Pairs whose path is a call of the agent's model."""
    how, part = PATHS[agent]
    path = F.regexp_replace(F.regexp_replace(F.col(url), r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return pairs.filter({"prefix": F.startswith(path, F.lit(part)), "suffix": F.endswith(path, F.lit(part)), "part": F.contains(F.lower(path), F.lit(part))}[how])


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_path, line (from 0, in the file's order) and raw of every line that is not blank. Missing files and those
    that can't be opened give none, and a file that can't be read to its end gives the lines before.

    A block of a file is read in order by one task, so the block's start and the row's number within it order lines.
    """
    if not paths:
        return spark.createDataFrame([], "source_path string, line long, raw string")
    text = spark.read.option("lineSep", "\n").option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).text(list(paths))
    text = text.select(F.expr("_metadata.file_path").alias("file"), F.expr("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.trim(F.regexp_replace("value", "\r$", "")).alias("raw"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("block", "n")) - 1
    plain = F.regexp_replace(F.url_decode("file"), "^file:/*", "/")
    return text.filter("raw <> ''").select(plain.alias("source_path"), place.cast("long").alias("line"), "raw")


def pairs(spark: SparkSession, paths: list[str], loose: bool = False) -> DataFrame:
    """source_path, pair_index, ts, raw of every line that is JSON (loose: an object with a request or a response), in
    order; pair_index counts the lines kept. Other lines are dropped."""
    return json_pairs(lines(spark, paths), loose)


def json_pairs(rows: DataFrame, loose: bool = False) -> DataFrame:
    """pairs of lines already read."""
    rows = rows.withColumn("v", F.try_parse_json("raw")).filter("v is not null")
    if loose:
        rows = rows.filter(F.expr("schema_of_variant(v) like 'OBJECT<%' and (try_variant_get(v, '$.request', 'variant') is not null or try_variant_get(v, '$.response', 'variant') is not null)"))
    place = F.row_number().over(Window.partitionBy("source_path").orderBy("line")) - 1
    ts = F.coalesce(F.expr("try_variant_get(v, '$.request.timestamp', 'double')"), F.lit(0.0))
    return rows.select("source_path", place.cast("long").alias("pair_index"), ts.alias("ts"), "raw")


def pairs_or_fail(spark: SparkSession, paths: list[str]) -> DataFrame:
    """pairs, or an error where there are none."""
    found = pairs(spark, paths)
    if not found.limit(1).count():
        raise ValueError(f"no captured pairs in {', '.join(paths)}")
    return found


def hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_path, content_hash, mtime_ms, size of each file that is there."""
    if not paths:
        return spark.createDataFrame([], "source_path string, content_hash string, mtime_ms long, size long")
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(list(paths))
    return files.select(F.regexp_replace(F.url_decode("path"), "^file:/*", "/").alias("source_path"), F.sha2("content", 256).alias("content_hash"), (F.unix_micros("modificationTime") / 1000).cast("long").alias("mtime_ms"), F.col("length").alias("size"))


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is not the one known under their path."""
    return found.join(known.select("source_path", "content_hash"), ["source_path", "content_hash"], "left_anti")


def append(path: str, pair: dict, mode: str = "standard") -> bool:
    """Adds a pair to a log as one line, its bodies redacted; whether that went well, as a log never stops its writer."""
    try:
        line = json.dumps(redact_pair(pair, mode), ensure_ascii=False) + "\n"
        with open(path, "a", encoding="utf-8") as f:
            f.write(line)
    except (OSError, TypeError, ValueError):
        return False
    return True
