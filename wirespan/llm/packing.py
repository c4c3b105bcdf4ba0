"""Best-fit packing of token sequences: hierarchical residual packing.

Each partition packs its own pieces best-fit decreasing. Bins that are nearly full leave at once; each underfull bin
becomes one item of its fill, and partitions of such items merge, fewer each round, for another best-fit round, until
one round's items fit one bounded task or merging stops paying. Capacity is a small integer, so the open bins of a task
are kept by free space in a bit set and each item is placed in constant time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, stored
from .encoding import encoder

CAPACITY = 1024
END_ID = 2
#: Items that one task packs at most; rounds go on with more partitions while more are left.
TASK_ITEMS = 200_000
#: A bin whose free space is at most this leaves before the last round.
SLACK = 4

PIECES = "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids, ids_crc32.

    A document is its whole text's ids and the end id; null and empty texts are the end id alone. A longer one than
    capacity is cut into pieces of capacity, of which the first takes what is left over. Rows with the same doc_id,
    null ones too, stay separate documents.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            doc, no, start, length, crc, data = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    to = min(n, at + (n % capacity or capacity if k == 0 and n > capacity else capacity))
                    part = ids[4 * at : 4 * to]
                    doc.append(doc_id)
                    no.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(part))
                    data.append(part)
                    at, k = to, k + 1
            values = pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32, copy=False))
            offsets = np.zeros(len(length) + 1, np.int32)
            np.cumsum(length, out=offsets[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of each item and offset in it: largest first, each into the fullest open bin that still takes it."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, at, count = capacity, count, count + 1
        bins[item], offsets[item] = at, capacity - room
        left = room - size
        if left:
            free[left].append(at)
            mask |= 1 << left
    return bins, offsets


def pack(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, task_items: int = TASK_ITEMS) -> DataFrame:
    """Bin (sequence_id) and place (offset) of each item: the rows of items (item long, unique; length long in
    1..capacity) with sequence_id long and offset long; gapless from 0 in each bin. No item is lost or split.

    Round r packs each partition's items and gives each bin the id of its first item; the links item -> bin of all
    rounds are composed at the end, from the last round to the first, each an equal join on ids. Rounds end when one
    bounded task could hold all items, or when a round leaves over 99 % of its items (then nothing more fits together).
    """
    spark = items.sparkSession

    def round_(batches: Iterator, last: bool) -> Iterator:
        import pyarrow as pa

        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        ids, sizes = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        order = np.lexsort((ids, -sizes))  # the same bins in every run
        ids, sizes = ids[order], sizes[order]
        bins, offsets = best_fit(sizes, capacity)
        names = np.full(bins.max() + 1, -1, np.int64)
        names[bins[::-1]] = ids[::-1]  # the first item's id
        fill = np.bincount(bins, sizes).astype(np.int64)
        done = fill >= capacity - slack if not last else np.ones(len(fill), bool)
        for at in range(0, len(ids), 50_000):
            to = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[to]), pa.array(names[bins[to]]), pa.array(offsets[to]), pa.array(fill[bins[to]]), pa.array(done[bins[to]])], ["item", "bin", "offset", "fill", "done"])

    left = items.select(F.col("item"), F.col("length"))
    n = left.count()
    parts = max(1, min(partitions(spark), -(-n // 2000)), -(-n // task_items))
    rounds: list[DataFrame] = []
    while True:
        last = parts == 1
        step = stored(left.repartition(parts, F.xxhash64("item", F.lit(len(rounds)))).mapInArrow(lambda b, last=last: round_(b, last), "item long, bin long, offset long, fill long, done boolean"), "packing-round")
        rounds.append(step)
        if last:
            break
        left = step.filter(~F.col("done") & (F.col("item") == F.col("bin"))).select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        before, n = n, left.count()
        if n == 0 or n > 0.99 * before and n > task_items:
            break
        parts = -(-n // task_items) if n > task_items else max(1, min(parts // 4, -(-n // 20_000)))
    # From the last round back: where each bin of a round ended up.
    where = None
    for step in reversed(rounds):
        own = step.select("item", "bin", "offset")
        if where is None:
            where = own.select("item", F.col("bin").alias("sequence_id"), "offset")
        else:
            up = where.select(F.col("item").alias("bin"), F.col("sequence_id"), F.col("offset").alias("up_offset"))
            where = own.join(up, "bin", "left").select("item", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("up_offset", F.lit(0))).alias("offset"))
    return items.join(where, "item")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows, stored, with a unique number in column item."""
    return stored(df.withColumn("item", F.monotonically_increasing_id()), name)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs all documents: one row for each piece with its ids, sequence_id and offset (see pieces and pack).

    Full pieces are sequences of their own and take no part in the rounds. An empty table gives no rows; columns other
    than doc_id and text are ignored, whatever their names.
    """
    table = numbered(pieces(docs, vocabulary, capacity, end_id), "pieces")
    keys = table.select("item", "length")
    short = pack(keys.filter(F.col("length") < capacity), capacity).select("item", "sequence_id", "offset")
    full = keys.filter(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return table.join(short.unionByName(full), "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence: sequence_id, ids array<int>, n_pieces. A sequence has at most capacity ids."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.size("parts").alias("n_pieces"))
