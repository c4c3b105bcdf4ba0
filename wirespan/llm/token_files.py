"""Token-id files: Parquet list columns, dictionary-encoded ids, delta-encoded metadata, bounded row groups, page indexes.

Documents are dealt by ranges of doc_id, one file a range in ascending order. Each row holds one document's ids and, as
columns of their own, its length and place, so metadata is read without ids, and ids of a doc_id range without the rest:
row groups and page indexes let a reader skip to the pages it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_path, slices
from .encoding import encode_batch

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
#: Documents encoded at once: the more, the fewer words are looked up again.
ROWS = 2048
PAGE_BYTES = 64 << 10
#: Version 2 pages: columns without a dictionary are delta-encoded; ids keep a dictionary of up to so many bytes.
WRITER = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.column.index.truncate.length": "64",
    "compression": "zstd",
}
FILE_SCHEMA = "file_no int, doc_id long, at long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, files: int | None = None) -> None:
    """Encodes whole texts and writes them to path in ascending doc_id order, nulls first, rows of equal doc_id by text.

    Columns: file_no, doc_id, at (ids before it in its file), n_tokens, ids. Null and empty texts hold the end id alone.
    An empty table gives files without rows.
    """
    files = files or partitions(docs.sparkSession)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        file_no, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches, ROWS):
            counts, ids = encode_batch(vocabulary, batch.column(1), end_id)
            starts = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=offsets[1:])
            values = pa.array(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), file_no, np.int32)), batch.column(0), pa.array(starts), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), values)], ["file_no", "doc_id", "at", "n_tokens", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, FILE_SCHEMA).write.options(**WRITER).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens; reads no ids.

    The base of each file is the sum of the files before it: one row a file, summed in one small window.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path).select("file_no", "doc_id", "at", "n_tokens")
    return rows.join(F.broadcast(_bases(rows)), "file_no").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens")


def _bases(rows: DataFrame) -> DataFrame:
    totals = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents with doc_id from first to last (all, if not given).

    The bounds reach the scan as pushed filters, which skip row groups and pages. The bases, a row a file, are broadcast:
    ids go through no shuffle.
    """
    table = spark.read.schema(FILE_SCHEMA).parquet(path)
    rows = table
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.join(F.broadcast(_bases(table)), "file_no").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows from read_tokens."""

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(), "<i4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Writes the documents' ids to files in the shared folder and returns what reading them back gives."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(spark, path)
