"""N-gram Jaccard join: documents linked when their sets of word shingles are similar enough, and their components.

The incidence matrix of documents by n-grams is multiplied with its transpose in blocks of n-grams (ranges of their
hashes), each within one task, so that only pairs of documents leave it, with their overlap in the block. Equal sets are
one row of the matrix. Only the columns that a pair must share enter: under one order of all n-grams, two sets as similar
as asked share an n-gram among the first n - ceil(t n) + 1 of either. Frequent n-grams come last in that order and stay out
of the blocks, so that the columns there are short and their product grows with the input.

Pairs whose overlap in the blocks plus what the rest could add stays under the size-derived need are discarded, and so are
those whose overlap can't be enough by their sketches, counts of n-grams by bits of their hashes; the others are counted
in full. A pair without a common n-gram in the blocks shares frequent ones alone. Only rows that are mostly
frequent can be that similar: they meet by their sets of frequent n-grams, in a product of their own (see frequent_links).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, partitions, release, slices, stored, trimmed
from .components import components
from .shingles import set_keys, shingle_sets, text_bytes

WORDS = 5
PERCENT = 75
#: N-grams in more documents than this are frequent; the list of them has LISTED entries at most, the commonest. Both only
#: set where a pair is found: the result is the same for any values.
FREQUENT = 16
LISTED = 1_000_000
#: N-grams that a task gathers before it deals them out to the blocks, and pairs that it holds before it adds them up.
GATHERED = 1 << 20
PAIRS = 1 << 20
#: Texts of which a task remembers that it has sent their set, so that copies send it once.
REMEMBERED = 1 << 20
#: Rounds that try one pair a row before all others.
ROUNDS = 2
#: Rows on a side of one product of rows that share a frequent n-gram.
SIDE = 1024

_COUNTS = "block int, grams binary, counts binary, doc_id long, n_shingles long, node long, version long"
_COLUMNS = "block int, grams binary, nodes binary, sizes binary, node long, n int, ids array<int>, sketch binary"
_FREQUENT_ROW = np.uint32(1 << 31)


def _first(counts: np.ndarray, percent: int) -> np.ndarray:
    """How many columns of a set of so many n-grams take part: n - ceil(t n) + 1, none of an empty one."""
    return np.where(counts > 0, counts + (-percent * counts) // 100 + 1, 0)


def _width(blocks: int) -> np.uint64:
    return np.uint64(2**64 // blocks + 1)


def _dealt(grams: np.ndarray, others: list[np.ndarray], blocks: int) -> Iterator[tuple[int, list[bytes]]]:
    """Number and contents of each block of the ascending n-grams and of what goes with each."""
    cuts = np.append(np.searchsorted(grams, np.arange(blocks, dtype=np.uint64) * _width(blocks)), len(grams))
    for block in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        part = slice(cuts[block], cuts[block + 1])
        yield block, [x[part].tobytes() for x in (grams, *others)]


def _blocks_of(batches: Iterator, names: tuple[str, ...]) -> Iterator[list[bytes]]:
    """Contents of each block, from rows in order of blocks."""
    held: list[list[bytes]] = [[] for _ in names]
    last = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
        for i, block in enumerate(batch.column(0).to_pylist()):
            if not columns[0][i].is_valid:
                continue
            if block != last and held[0]:
                yield [b"".join(x) for x in held]
                held = [[] for _ in names]
            last = block
            for x, c in zip(held, columns, strict=True):
                x.append(c[i].as_py())
    if held[0]:
        yield [b"".join(x) for x in held]


def _sketches(hashes: np.ndarray, counts: np.ndarray):
    """For each set how many of its n-grams have each value of the low bits of their hashes, one byte a value; as many
    values as a quarter to half of its n-grams. Null where a count is too large for a byte."""
    import pyarrow as pa

    width = 1 << np.maximum(3, np.log2(np.maximum(counts, 1)).astype(np.int64) - 1)
    ends = np.cumsum(width)
    text = np.repeat(np.arange(len(counts)), counts)
    bins = np.bincount((ends - width)[text] + (hashes & (width - 1).astype(np.uint64)[text]).astype(np.int64), minlength=int(ends[-1]))
    most = np.maximum.reduceat(bins, ends - width)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(bins.astype(np.uint8).tobytes())])
    return pa.compute.if_else(pa.array(most < 256), packed, pa.scalar(None, pa.binary()))


def _may_meet(a: bytes | None, b: bytes | None, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m n-grams can have enough in common by their sketches."""
    if a is None or b is None:
        return True
    x, y = (np.frombuffer(s, np.uint8).astype(np.int32) for s in (a, b))
    least = min(len(x), len(y))
    common = int(np.minimum(x.reshape(-1, least).sum(0), y.reshape(-1, least).sum(0)).sum())
    return (100 + percent) * common >= percent * (n + m)


def _unseen(keys: np.ndarray, counts: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which texts have a set of shingles that this task has not met; remembers them."""
    if len(seen) > REMEMBERED:
        seen.clear()
    fresh = np.zeros(len(keys), bool)
    for i, key in enumerate(keys.tolist()):
        if counts[i] and key not in seen:
            seen.add(key)
            fresh[i] = True
    return fresh


def _in_blocks(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "block").sortWithinPartitions("block")


def counted_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Stored rows of two kinds: doc_id, n_shingles, node (64-bit key of the set of shingles, 0 if empty) and version (hash
    of the text) of each document; gram and c (how many sets have it, about) of each frequent n-gram."""
    blocks = 4 * partitions(docs.sparkSession)

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("block", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), *((x, pa.int64()) for x in ("doc_id", "n_shingles", "node", "version"))])
        held: list[np.ndarray] = []
        size = turn = 0
        seen: set[int] = set()

        def deal() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            rows = list(_dealt(grams, [counts.astype(np.uint32)], blocks))
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), *(pa.array([x[k] for _, x in rows], pa.binary()) for k in (0, 1)), none, none, none, none], schema=schema)

        for batch in slices(batches):
            hashes, counts = shingle_sets(*text_bytes(batch.column(2)), words)
            keys = set_keys(hashes, counts)
            none = pa.nulls(len(counts), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(((turn + np.arange(len(counts))) % blocks).astype(np.int32)), none, none, batch.column(0), pa.array(counts), pa.array(keys), batch.column(1)], schema=schema)
            turn += len(counts)
            own = hashes[np.repeat(_unseen(keys, counts, seen), counts)]
            if len(own):
                held.append(own)
                size += len(own)
            if size >= GATHERED:
                yield deal()
                held, size = [], 0
        if held:
            yield deal()

    def summed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["gram", "c", "doc_id", "n_shingles", "node", "version"]

        def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = batch.filter(pc.is_valid(batch.column(5)))
            return pa.RecordBatch.from_arrays([pa.nulls(own.num_rows, pa.int64())] * 2 + own.columns[3:], names)

        passed: list = []

        def noted() -> Iterator:
            for batch in batches:
                passed.append(sets_of(batch))
                yield batch

        for grams, counts in _blocks_of(noted(), ("grams", "counts")):
            yield from passed
            passed.clear()
            grams, counts = np.frombuffer(grams, np.uint64), np.frombuffer(counts, np.uint32)
            order = np.argsort(grams, kind="stable")
            grams, counts = grams[order], counts[order].astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            sums = np.add.reduceat(counts, starts)
            often = sums > FREQUENT
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(grams[starts][often].view(np.int64)), pa.array(sums[often]), none, none, none, none], names)
        yield from passed

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("version"), F.col("text").cast("string"))
    rows = _in_blocks(rows.mapInArrow(trimmed(sets), _COUNTS))
    return stored(rows.mapInArrow(trimmed(summed), "gram long, c long, doc_id long, n_shingles long, node long, version long"), "join-sets")


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest n-grams, LISTED at most, ascending; and the rank of each, rarest first."""
    often = counts.filter("c is not null").orderBy(F.desc("c"), "gram").limit(LISTED).select("gram").toArrow().column(0).to_numpy().view(np.uint64)
    order = np.argsort(often)
    return often[order], (len(often) - 1 - order).astype(np.int32)


def _pairs_of(nodes: np.ndarray, sizes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs within each column (rows starts[i], starts[i] + 1, ...) that are near enough in size; rows
    of a column are in order of sizes."""
    n = (sizes & ~_FREQUENT_ROW).astype(np.int64)
    for length in np.unique(lengths).tolist():
        at = starts[lengths == length]
        if length <= 64:
            i, j = np.triu_indices(length, 1)
            step = max(1, PAIRS // len(i))
            for k in range(0, len(at), step):
                a, b = ((at[k : k + step, None] + x[None]).ravel() for x in (i, j))
                near = 100 * n[a] >= percent * n[b]
                yield a[near], b[near]
        else:  # of n-grams that the list had no place for
            for first in at.tolist():
                column = n[first : first + length]
                stops = np.searchsorted(column, 100 * column // percent, "right")
                for i in range(length):
                    b = np.arange(first + i + 1, first + stops[i])
                    yield np.full(len(b), first + i), b


def _product(grams: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """a, b, overlap, lack of each pair of rows with a common column in a block; lack: the least overlap in all blocks
    that can still meet the need of both sizes."""
    order = np.lexsort((sizes & ~_FREQUENT_ROW, nodes, grams))
    grams, nodes, sizes = grams[order], nodes[order], sizes[order]
    once = np.ones(len(grams), bool)
    once[1:] = (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])
    grams, nodes, sizes = grams[once], nodes[once], sizes[once]
    shared = np.zeros(len(grams), bool)
    shared[1:] = grams[1:] == grams[:-1]
    shared[:-1] |= shared[1:]
    grams, nodes, sizes = grams[shared], nodes[shared], sizes[shared]
    if not len(grams):
        return
    order = np.lexsort((nodes, sizes & ~_FREQUENT_ROW, grams))
    grams, nodes, sizes = grams[order], nodes[order], sizes[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    lengths = np.diff(np.append(starts, len(grams)))
    held, size = [], 0

    def added_up() -> tuple[np.ndarray, ...]:
        one, other = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        low = np.where(nodes[one] < nodes[other], one, other)
        high = one + other - low
        order = np.lexsort((nodes[high], nodes[low]))
        low, high = low[order], high[order]
        a, b = nodes[low], nodes[high]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        overlap = np.diff(np.append(first, len(a)))
        n = [(sizes[x[first]] & ~_FREQUENT_ROW).astype(np.int64) for x in (low, high)]
        # What follows the first columns of a row; a row that reaches frequent ones may share them all.
        rest = [np.where(sizes[x[first]] & _FREQUENT_ROW, m, m - _first(m, percent)) for x, m in zip((low, high), n, strict=True)]
        lack = -(-percent * (n[0] + n[1]) // (100 + percent)) - np.maximum(*rest)
        return a[first], b[first], overlap.astype(np.int32), np.maximum(lack, 1).astype(np.int32)

    for pair in _pairs_of(nodes, sizes, starts, lengths, percent):
        if len(pair[0]):
            held.append(pair)
            size += len(pair[0])
        if size >= PAIRS:
            yield added_up()
            held, size = [], 0
    if held:
        yield added_up()


def block_products(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Stored rows of two kinds: a, b, overlap, lack of pairs in each block (see _product); node, n, sketch of each set, with
    ids (its frequent n-grams, rarest first) where its first columns reach the frequent ones."""
    spark = docs.sparkSession
    blocks = 4 * partitions(spark)
    shared = spark.sparkContext.broadcast(frequent)

    def columns(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        schema = pa.schema([("block", pa.int32()), ("grams", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("node", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int32())), ("sketch", pa.binary())])
        listed, ranks = shared.value
        held: list[tuple] = []
        size = 0
        seen: set[int] = set()

        def deal() -> pa.RecordBatch:
            grams, nodes, sizes = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.argsort(grams, kind="stable")
            rows = list(_dealt(grams[order], [nodes[order], sizes[order]], blocks))
            none = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), *(pa.array([x[k] for _, x in rows], pa.binary()) for k in range(3)), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.list_(pa.int32())), pa.nulls(none, pa.binary())], schema=schema)

        for batch in slices(batches):
            hashes, counts = shingle_sets(*text_bytes(batch.column(0)), words)
            keys = set_keys(hashes, counts)
            fresh = _unseen(keys, counts, seen)
            hashes, counts, keys = hashes[np.repeat(fresh, counts)], counts[fresh], keys[fresh]
            if not len(hashes):
                continue
            text = np.repeat(np.arange(len(counts)), counts)
            often = np.zeros(len(hashes), bool)
            at = np.zeros(len(hashes), np.int64)
            if len(listed):
                at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
                often = listed[at] == hashes
            rare = np.cumsum(~often)  # place among the rare ones, from 1
            before = np.concatenate([[0], rare])[np.cumsum(counts) - counts]
            n_rare = rare[np.cumsum(counts) - 1] - before
            first = _first(counts, percent)
            keep = ~often & (rare - before[text] <= first[text])
            reach = n_rare < first
            sizes = counts.astype(np.uint32) | np.where(reach, _FREQUENT_ROW, np.uint32(0))
            held.append((hashes[keep], keys[text[keep]], sizes[text[keep]]))
            size += int(keep.sum())
            own = often & reach[text]
            order = np.lexsort((ranks[at[own]], text[own])) if own.any() else np.zeros(0, np.int64)
            ids = ranks[at[own]][order] if own.any() else np.zeros(0, np.int32)
            k = len(counts)
            offsets = np.zeros(k + 1, np.int32)
            np.cumsum(np.where(reach, counts - n_rare, 0), out=offsets[1:])
            lists = pa.compute.if_else(pa.array(reach), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.scalar(None, pa.list_(pa.int32())))
            block = (keys.view(np.uint64) // _width(blocks)).astype(np.int32)
            none = pa.nulls(k, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(block), none, none, none, pa.array(keys), pa.array(counts.astype(np.int32)), lists, _sketches(hashes, counts)], schema=schema)
            if size >= GATHERED:
                yield deal()
                held, size = [], 0
        if size:
            yield deal()

    def multiplied(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int32()), ("lack", pa.int32()), ("node", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int32())), ("sketch", pa.binary())])
        rows: list = []
        sent: set[int] = set()

        def noted() -> Iterator:
            for batch in batches:
                own = batch.filter(pc.is_valid(batch.column(4)))
                fresh = []
                for node in own.column(4).to_pylist():
                    fresh.append(node not in sent)
                    sent.add(node)
                own = own.filter(pa.array(fresh, pa.bool_()))
                if own.num_rows:
                    none = [pa.nulls(own.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
                    rows.append(pa.RecordBatch.from_arrays([*none, own.column(4), own.column(5), own.column(6).cast(schema.types[6]), own.column(7)], schema=schema))
                yield batch

        for grams, nodes, sizes in _blocks_of(noted(), ("grams", "nodes", "sizes")):
            yield from rows
            rows.clear()
            for pairs in _product(np.frombuffer(grams, np.uint64), np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.uint32), percent):
                n = len(pairs[0])
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in pairs), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.binary())], schema=schema)
        yield from rows

    rows = _in_blocks(docs.select(F.col("text").cast("string")).mapInArrow(trimmed(columns), _COLUMNS))
    return stored(rows.mapInArrow(trimmed(multiplied), "a long, b long, overlap int, lack int, node long, n int, ids array<int>, sketch binary"), "join-products")


def _sketched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b, overlap) that can be similar enough by the sketches of their sets (node, n, sketch)."""

    def bounded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            rows = zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True)
            keep = pa.array([_may_meet(a, b, n, m, percent) for n, a, m, b in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1, 2)], ["a", "b", "overlap"])

    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "overlap", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(trimmed(bounded), "a long, b long, overlap long")


def _hubs(pairs: DataFrame) -> DataFrame:
    """For each row of pairs (a, b, overlap), the smallest it may link to among those that share half as much with it as
    the nearest does: rows of a group of copies all take the same one."""
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap"))
    near = both.groupBy("a").agg(F.max("overlap").alias("most"))
    hubs = both.join(near, "a").filter(2 * F.col("overlap") >= F.col("most")).groupBy("a").agg(F.min("b").alias("b"))
    return hubs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified_links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that join what those of pairs (a, b, overlap) that are similar enough join.

    Two rounds try one pair a row, which joins groups of copies; then all pairs whose rows are still apart are tried.
    """
    links = None
    for _ in range(ROUNDS):
        hubs = stored(_hubs(pairs), "join-hubs")
        found = stored(_similar(hubs, texts, words, percent), "join-links")
        links = found if links is None else links.union(found)
        parts = components(links)
        of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        left = pairs.join(hubs, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        left = left.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
        left = stored(left.select("a", "b", "overlap"), "join-pairs")
        discard(pairs, hubs)
        pairs = left
        release(texts.sparkSession)
    links = links.union(stored(_similar(pairs.select("a", "b"), texts, words, percent), "join-links"))
    discard(pairs)
    return links


def _similar(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough, from the full sets of both texts (node, text)."""

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 256):
            left, n = shingle_sets(*text_bytes(batch.column(2)), words)
            right, m = shingle_sets(*text_bytes(batch.column(3)), words)
            row = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
            both = np.concatenate([left, right])
            order = np.lexsort((both, row))
            both, row = both[order], row[order]
            again = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
            common = np.bincount(row[1:][again], minlength=len(n))
            keep = 100 * common >= percent * (n + m - common)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(trimmed(counted), "a long, b long")


def _texts(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored node and text of one document for each of nodes."""
    row = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "version"))
    named = sets.join(nodes, "node", "left_semi").groupBy("node").agg(row.alias("row")).select("node", F.col("row.doc_id").alias("d"), F.col("row.version").alias("v"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    found = rows.join(named, rows["doc_id"].eqNullSafe(named["d"]) & (rows["version"] == named["v"])).select("node", "doc_id", "text")
    # Rows that repeat a document with its doc_id only repeat links; nameless copies may be many.
    return stored(found.filter("doc_id is not null").select("node", "text").union(found.filter("doc_id is null").select("node", "text").dropDuplicates(["node"])), "join-texts")


def _meets(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (n + m)


def frequent_links(rows: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """Links that join what pairs of rows (node, n, ids: its frequent n-grams, rarest first) similar enough by these
    alone join; None without rows.

    Rows with the same ids differ in size alone, so the smallest of them has a link wherever another has one: it stands
    for them. Representatives meet by columns, as sets of any kind, but by their frequent n-grams only. First each meets
    the most frequent-laden one of its columns, which joins large groups of copies with one link a row; then those that
    are still apart meet in blocks, each a matrix product within a task. A row that is too large for its representative
    can have a link to a smaller one only: of all that its representative meets, the one that admits the largest rows.
    """
    rows = stored(rows, "join-frequent")
    if not rows.limit(1).count():
        return None
    least = F.min(F.struct("n", "node"))
    groups = rows.groupBy("ids").agg(least.alias("least"), F.max("n").alias("most"))
    groups = stored(groups.select(F.col("least.node").alias("sig"), F.col("least.n").alias("n"), "ids", F.size("ids").alias("s"), "most"), "join-representatives")
    members = rows.select(F.col("node"), F.col("n").alias("own_n"), "ids").join(groups.select("sig", "n", "s", "ids"), "ids").filter("node <> sig").select("node", "own_n", "sig", "n", "s")
    alike = _meets(F.col("s"), F.col("own_n"), F.col("n"), percent)
    links = [members.filter(alike).select(F.col("node").alias("a"), F.col("sig").alias("b"))]
    # Whether a row may be too large for its representative and small enough to have a link at all.
    groups = groups.withColumn("wide", ~_meets(F.col("s"), F.col("most"), F.col("n"), percent) & (F.col("most") > F.col("n")))
    first = F.col("s") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1
    columns = groups.filter(first > 0).select("sig", "n", "s", "wide", F.posexplode(F.slice("ids", F.lit(1), first)).alias("place", "id"))
    columns = stored(columns, "join-frequent-columns")
    # One link a row: to the row of its column and size class that is frequent to the largest part.
    sized = columns.withColumn("shift", F.explode(F.array(F.lit(0.0), F.lit(0.5))))
    sized = sized.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + F.col("shift")))
    heads = sized.groupBy("id", "shift", "class").agg(F.max(F.struct((F.col("s") / F.col("n")).alias("part"), "sig")).alias("head"), F.count("*").alias("c")).filter("c > 1")
    star = sized.join(heads, ["id", "shift", "class"]).filter("sig <> head.sig").select(F.col("sig").alias("a"), F.col("head.sig").alias("b")).distinct()
    side = lambda x: groups.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("ids").alias(f"ids_{x}"))
    star = star.join(side("a"), "a").join(side("b"), "b").filter(_meets(F.size(F.array_intersect("ids_a", "ids_b")), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    star = stored(star, "join-frequent-star")
    links.append(star)
    parts = components(star)
    columns = columns.join(parts.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    columns = stored(columns, "join-frequent-apart")
    apart = columns.groupBy("id").agg(F.count("*").alias("c"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("wide").alias("any_wide"))
    apart = apart.filter((F.col("c") > 1) & ((F.col("low") < F.col("high")) | F.col("any_wide"))).select("id", F.ceil(F.col("c") / SIDE).cast("int").alias("m"))
    placed = columns.join(apart, "id").withColumn("i", F.pmod(F.xxhash64("sig"), F.col("m")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    placed = placed.select("id", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "sig", "n", (F.col("s") - F.col("place")).alias("left"), "component", "wide")
    placed = placed.repartition(partitions(rows.sparkSession), "id", "lo", "hi").sortWithinPartitions("id", "lo", "hi")
    met = placed.mapInArrow(lambda batches: _met(batches, percent), "a long, b long").distinct()
    met = met.join(side("a"), "a").join(side("b"), "b").withColumn("w", F.size(F.array_intersect("ids_a", "ids_b"))).select("a", "b", "n_a", "n_b", "w")
    met = stored(met, "join-frequent-product")
    links.append(met.filter(_meets(F.col("w"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b"))
    # The size up to which each admits a row that has the other's frequent n-grams.
    admits = lambda x, y: met.select(F.col(x).alias("sig"), F.col(y).alias("other"), (F.floor(F.lit(100 + percent) * F.col("w") / percent) - F.col(f"n_{y}")).alias("most"))
    admits = admits("a", "b").union(admits("b", "a")).groupBy("sig").agg(F.max(F.struct("most", "other")).alias("best"))
    wide = members.filter(~alike).join(admits, "sig").filter(F.col("own_n") <= F.col("best.most")).select(F.col("node").alias("a"), F.col("best.other").alias("b"))
    links.append(wide)
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    out = stored(out, "join-frequent-links")
    discard(rows, star, met)
    return out


def _met(batches: Iterator, percent: int) -> Iterator:
    """Pairs (a < b) of the rows of each (id, lo, hi) that are apart, or of which one is wide, and that have enough left
    from this column on: in the first column that two rows share, no more than that can be common."""
    import pyarrow as pa

    def pairs(parts: list) -> Iterator:
        i, sig, n, left, component, wide = (np.concatenate([np.asarray(p.column(k).to_numpy(zero_copy_only=False)) for p in parts]) for k in range(3, 9))
        n, left = n.astype(np.int64), left.astype(np.int64)
        lo, hi = parts[0].column(1)[0].as_py(), parts[0].column(2)[0].as_py()
        one, other = np.flatnonzero(i == lo), np.flatnonzero(i == hi)
        for at in range(0, len(one), SIDE):
            x = one[at : at + SIDE, None]
            y = other[None]
            take = (component[x] != component[y]) | wide[x] | wide[y]
            take &= (100 + percent) * np.minimum(left[x], left[y]) >= percent * (n[x] + n[y])
            take &= (sig[x] < sig[y]) if lo == hi else (sig[x] != sig[y])
            a, b = np.nonzero(take)
            a, b = sig[one[at + a]], sig[other[b]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[:, start].tolist())
            if held and key != last:
                yield from pairs(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield from pairs(held)


def similar_links(docs: DataFrame, counts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between different sets that give the same components as all pairs similar enough."""
    spark: SparkSession = docs.sparkSession
    products = block_products(docs, _frequent(counts), words, percent)
    release(spark)
    pairs = products.filter("a is not null").groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.max("lack").alias("lack"))
    pairs = pairs.filter("overlap >= lack").select("a", "b", "overlap")
    pairs = stored(_sketched(pairs, products.filter("node is not null").select("node", "n", "sketch"), percent), "join-pairs")
    release(spark)
    sets = counts.filter("node <> 0").select("doc_id", "node", "version")
    texts = _texts(docs, sets, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    release(spark)
    links = verified_links(pairs, texts, words, percent)
    discard(texts)
    release(spark)
    more = frequent_links(products.filter("ids is not null").select("node", "n", "ids"), percent)
    discard(products)
    return links if more is None else links.union(more)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each document (doc_id, text).

    Null and empty texts have no shingles, and link with nothing: their component is their own doc_id. Repeated rows
    are equal sets. A null doc_id keeps its row and its links, but names no component. Other columns are ignored.
    """
    counts = counted_sets(docs, words)
    release(docs.sparkSession)
    sets = counts.filter("node is not null").select("doc_id", "n_shingles", "node")
    joined = components(similar_links(docs, counts, words, percent))
    placed = sets.filter("node <> 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    where = placed.join(names, "component").select("node", "component_id")
    found = sets.filter("node <> 0").join(where, "node").select("doc_id", "n_shingles", "component_id")
    return found.union(sets.filter("node = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, less those whose component has a smaller doc_id: one of each group stays. Rows
    without a doc_id stay; of rows that repeat a doc_id, all stay or none."""
    found = jaccard_components(docs, words, percent)
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
