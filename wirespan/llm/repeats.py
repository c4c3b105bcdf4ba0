"""Suffix-array dedup: bytes covered by a long string that also starts earlier in the corpus.

A global suffix array cannot be held by one task, so strings that may repeat are brought together first. Every window
of WINDOW bytes has an anchor, the least-hashed of its GRAM-byte substrings (leftmost of equals), so equal windows have
equal anchors; the windows of a text with the same anchor are one segment. Segments whose anchor no other has hold no
repeat. Equal segments are copies of the earliest one. The different segments of an anchor meet in one task, whose
Burrows-Wheeler transform says which of their windows are equal (see suffix_array). An anchor of very many different
segments, such as the edge of a common passage, is parted first: its windows by where the anchor is in them, and those by
the bytes around the anchor that all of them have, again and again until a task can hold what is left of one.

A document is named by its doc_id and version, a hash of its text, as rows may share a doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, slices, stored, trimmed
from .shingles import mixed, text_bytes
from .suffix_array import equal_windows

WINDOW = 100
GRAM = 32
#: Bytes hashed at once, and bytes of segments transformed at once.
CHUNK = 1 << 20
TASK_BYTES = 1 << 20
#: Anchors with more different segments than this are parted before they are transformed.
VARIANTS = 1000

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(77))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, CHUNK + 4096), _powers(_BASE_INVERSE, CHUNK + 4096)


def segments(buffer: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Start, number of windows, anchor hash and content hash of each segment of buffer, which holds whole texts or
    chunks of one; ends[i] is the end of the text that holds byte i. At most CHUNK + 4096 bytes."""
    n = len(buffer)
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    if n < window:
        return none
    values = _BYTE[buffer]
    grams, width = values, 1
    while width < gram:
        grams = grams[:-width] * _UP[width] + grams[width:]
        width *= 2
    grams = mixed(grams)
    low = _U(0xFFFFFF)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    places, width = window - gram + 1, 1
    while 2 * width <= places:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < places:
        least = np.minimum(least[: len(least) - (places - width)], least[places - width :])
    starts = np.arange(len(least))
    fits = starts + window <= ends[: len(least)]
    anchor = (least & low).astype(np.int64)
    new = fits.copy()
    new[1:] &= ~fits[:-1] | (anchor[1:] != anchor[:-1]) | (ends[1 : len(least)] != ends[: len(least) - 1])
    first = np.flatnonzero(new)
    if not len(first):
        return none
    stop = np.append(first[1:], len(least))
    # A segment also stops where windows stop fitting its text.
    stop = np.minimum(stop, ends[first] - window + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _UP[:n])])
    content = mixed((sums[stop + window - 1] - sums[first]) * _DOWN[first] + (stop - first).astype(np.uint64))
    return first, stop - first, grams[anchor[first]], content


def _versioned(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def text_segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """anchor, content, doc_id, version, at, n: the segments of each text; n windows start at bytes at, at + 1, ..."""

    def rows(doc_ids: list, versions: list, buffer: np.ndarray, offsets: np.ndarray) -> Iterator:
        import pyarrow as pa

        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at, n, anchor, content = segments(buffer, offsets[1:][text] if len(text) else text, window, gram)
        if len(at):
            own = text[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), doc_ids.take(pa.array(own)), versions.take(pa.array(own)), pa.array((at - offsets[own]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["anchor", "content", "doc_id", "version", "at", "n"],
            )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            buffer, offsets = text_bytes(batch.column(2))
            ids, versions = batch.column(0), batch.column(1)
            i, texts = 0, len(offsets) - 1
            while i < texts:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
                size = int(offsets[j] - offsets[i])
                if size <= CHUNK:
                    yield from rows(ids.slice(i, j - i), versions.slice(i, j - i), buffer[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                else:  # a text longer than a chunk: chunks that overlap by a window less one byte
                    for a in range(0, size, CHUNK):
                        part = buffer[offsets[i] + a : offsets[i] + min(size, a + CHUNK + window - 1)]
                        for found in rows(ids.slice(i, 1), versions.slice(i, 1), part, np.array([0, len(part)])):
                            at = pa.array(found.column(4).to_numpy() + np.int32(a))
                            yield pa.RecordBatch.from_arrays([*found.columns[:4], at, found.column(5)], ["anchor", "content", "doc_id", "version", "at", "n"])
                i = j

    return _versioned(docs).mapInArrow(trimmed(run), "anchor long, content long, doc_id long, version long, at int, n int")


def _variants_removed(parts: DataFrame, window: int) -> DataFrame:
    """doc_id, version, s, e: removed bytes of the different segments (anchor, doc_id, version, at, bytes) of each anchor."""

    def judged(rows: list[tuple]) -> tuple[list, list, list, list]:
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        label, text, offset = equal_windows([r[4] for r in rows], window)
        if not len(label):
            return [], [], [], []
        # Rows are in corpus order, but segments of one document overlap: windows order by document, then place.
        doc = np.cumsum([0] + [a[1:3] != b[1:3] for a, b in zip(rows[1:], rows, strict=False)])
        place = np.array([r[3] for r in rows])[text] + offset
        order = np.lexsort((place, doc[text], label))
        label, text, offset, place = label[order], text[order], offset[order], place[order]
        later = np.zeros(len(label), bool)
        later[1:] = (label[1:] == label[:-1]) & ((doc[text][1:] != doc[text][:-1]) | (place[1:] != place[:-1]))
        # The first of a class, and the same window met again in an overlapping segment, stay.
        head = np.maximum.accumulate(np.where(np.concatenate([[True], label[1:] != label[:-1]]), np.arange(len(label)), 0))
        later &= (doc[text] != doc[text][head]) | (place != place[head])
        text, offset = text[later], offset[later]
        order = np.lexsort((offset, text))
        text, offset = text[order], offset[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(text)) - 1
        at = np.array([r[3] for r in rows], np.int64)[text[starts]] if len(starts) else np.zeros(0, np.int64)
        return [rows[t][1] for t in text[starts].tolist()], [rows[t][2] for t in text[starts].tolist()], (at + offset[starts]).tolist(), (at + offset[stops] + window).tolist()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []
        size = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in judged(held)], ["doc_id", "version", "s", "e"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= TASK_BYTES and row[0] != held[-1][0]:
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield out()

    return parts.select("anchor", "doc_id", "version", "at", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(run), "doc_id long, version long, s long, e long")


def _shared_segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Stored segments whose anchor occurs again, and whether all segments of the anchor are equal."""
    by_anchor = Window.partitionBy("anchor")
    rows = text_segments(docs, window, gram)
    rows = rows.withColumn("c", F.count("*").over(by_anchor)).withColumn("least", F.min("content").over(by_anchor)).withColumn("most", F.max("content").over(by_anchor))
    return stored(rows.filter("c > 1").select("anchor", "content", "doc_id", "version", "at", "n", (F.col("least") < F.col("most")).alias("varied")), "segments")


def _first_segments(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "version", "at")).alias("first"), F.first("n").alias("n"), F.first("varied").alias("varied")), "first-segments")


def _copies(rows: DataFrame, first: DataFrame, window: int) -> DataFrame:
    """Stored doc_id, version, s, e of the segments that an equal one comes before; in ranges of bytes."""
    copies = rows.join(first.select("anchor", "content", "first"), ["anchor", "content"]).filter(~F.struct("doc_id", "version", "at").eqNullSafe(F.col("first")))
    return stored(copies.select("doc_id", "version", F.col("at").cast("long").alias("s"), (F.col("at") + F.col("n") + (window - 1)).cast("long").alias("e")), "copied-ranges")


def _segment_bytes(docs: DataFrame, first: DataFrame, window: int) -> DataFrame:
    """Stored anchor, doc_id, version, at, bytes of the segments that differ under one anchor, cut from their texts."""
    varied = first.filter("varied").select("anchor", F.col("first.doc_id").alias("doc_id"), F.col("first.version").alias("version"), F.col("first.at").alias("at"), (F.col("n") + (window - 1)).alias("length"))
    wanted = varied.groupBy(F.col("doc_id").alias("d"), F.col("version").alias("of")).agg(F.collect_list(F.struct("anchor", "at", "length")).alias("wanted"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for doc_id, version, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                yield pa.RecordBatch.from_arrays([pa.array([p["anchor"] for p in parts], pa.int64()), pa.array([doc_id] * len(parts), pa.int64()), pa.array([version] * len(parts), pa.int64()), pa.array([p["at"] for p in parts], pa.int32()), pa.array([data[p["at"] : p["at"] + p["length"]] for p in parts], pa.binary())], ["anchor", "doc_id", "version", "at", "bytes"])

    texts = _versioned(docs).filter("text is not null")
    parts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["d"]) & (texts["version"] == wanted["of"])).select("doc_id", "version", "text", "wanted").mapInArrow(trimmed(cut), "anchor long, doc_id long, version long, at int, bytes binary")
    return stored(parts, "segment-bytes")  # a segment that repeated rows cut twice is one place, which removes nothing


def _parted(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """rows (key, lo, hi, lead, doc_id, version, at, bytes) in two parts each: windows with the anchor at lo to the middle,
    and above it. The key of a part is a digest of what its windows have in common around the anchor, so equal windows
    have equal keys. lead: place of the anchor in the first window, -1 if not known yet."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            out: list[tuple] = []
            for key, lo, hi, lead, doc_id, version, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lead < 0:
                    lead = _anchor(data[:window], gram)
                middle = (lo + hi) // 2
                for low, high in ((lo, middle), (middle + 1, hi)):
                    first, last = min(lead, high), max(lead - (len(data) - window), low)
                    if first < last:
                        continue
                    skip = lead - first
                    part = data[skip : skip + first - last + window]
                    common = part[first - low : first + window - high]
                    digest = hashlib.blake2b(key.to_bytes(8, "little", signed=True) + bytes((low % 256, high % 256)) + common, digest_size=8).digest()
                    out.append((int.from_bytes(digest, "little", signed=True), low, high, first, doc_id, version, at + skip, part))
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "lo", "hi", "lead", "doc_id", "version", "at", "bytes"])

    return rows.select("key", "lo", "hi", "lead", "doc_id", "version", "at", "bytes").mapInArrow(trimmed(run), "key long, lo int, hi int, lead int, doc_id long, version long, at int, bytes binary")


def _anchor(data: bytes, gram: int) -> int:
    """Place of the least-hashed gram of one window, as in segments()."""
    grams, width = _BYTE[np.frombuffer(data, np.uint8)], 1
    while width < gram:
        grams = grams[:-width] * _UP[width] + grams[width:]
        width *= 2
    return int(np.argmin(mixed(grams) & ~_U(0xFFFFFF)))


def _varied_ranges(parts: DataFrame, window: int, variants: int, gram: int = GRAM) -> DataFrame:
    """Stored doc_id, version, s, e of the repeats among segments that differ under one anchor.

    A round transforms the keys of at most `variants` different segments and parts the others. In a part, equal segments
    are copies of the earliest one, as among whole segments. Windows with the anchor at one place are parted by all their
    bytes, so no more rounds than the logarithm of a window's places are needed.
    """
    rows = parts.select(F.col("anchor").alias("key"), F.lit(0).alias("lo"), F.lit(window - gram).alias("hi"), F.lit(-1).alias("lead"), "doc_id", "version", "at", "bytes")
    found = None
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("hi") - F.col("lo")).alias("places")).filter("c > 1")
        is_large = (F.col("c") > variants) & (F.col("places") > 0)
        usual = rows.join(counts.filter(~is_large).select("key"), "key", "left_semi").select(F.col("key").alias("anchor"), "doc_id", "version", "at", "bytes")
        now = stored(_variants_removed(usual, window), "varied-ranges")
        found = now if found is None else found.unionByName(now)
        large = stored(_parted(rows.join(counts.filter(is_large).select("key"), "key", "left_semi"), window, gram), "segment-parts")
        if not large.limit(1).count():
            return found
        place = F.struct("doc_id", "version", "at")
        first = stored(large.groupBy("key", "bytes").agg(F.min(place).alias("first"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("lead").alias("lead"), F.count("*").alias("c")), "first-parts")
        copies = large.join(first.filter("c > 1").select("key", "bytes", "first"), ["key", "bytes"]).filter(~place.eqNullSafe(F.col("first")))
        copies = stored(copies.select("doc_id", "version", F.col("at").cast("long").alias("s"), (F.col("at") + F.length("bytes")).cast("long").alias("e")), "copied-ranges")
        found = found.unionByName(copies)
        rows = first.select("key", "lo", "hi", "lead", "first.doc_id", "first.version", "first.at", "bytes")


def removed_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, variants: int = VARIANTS) -> DataFrame:
    """doc_id, version, s, e: byte ranges covered by windows that also start earlier; ranges may overlap and repeat."""
    spark = docs.sparkSession
    rows = _shared_segments(docs, window, gram)
    release(spark)
    first = _first_segments(rows)
    copies = _copies(rows, first, window)
    release(spark)
    parts = _segment_bytes(docs, first, window)
    release(spark)
    varied = _varied_ranges(parts, window, variants, gram)
    release(spark)
    return copies.unionByName(varied)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (remaining bytes), n_bytes, n_removed, n_spans of each document (doc_id, text).

    A byte goes if a string of `window` bytes over it also starts earlier, in a smaller doc_id or before in the same
    text; strings are judged on the input. Null texts are empty; texts shorter than window stay whole. Rows that repeat
    a doc_id with its text are one document; rows that share a doc_id with different texts, null ones included, are
    documents of their own, in the order of their texts' hashes; a null doc_id comes first. Other columns are ignored.
    """
    # Ranges of a document join up in its own array; copies of whole texts send one range for each segment.
    gone = removed_ranges(docs, window, gram).groupBy(F.col("doc_id").alias("d"), F.col("version").alias("of")).agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    texts = _versioned(docs)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                kept, n, removed, spans = [], [], [], []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    out, at, count = [], 0, 0
                    joined: list[list[int]] = []
                    for s, e in sorted((r["s"], r["e"]) for r in ranges or []):
                        if joined and s <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], e)
                        else:
                            joined.append([s, e])
                    for s, e in joined:
                        out.append(data[at:s])
                        count += e - s
                        at = e
                    out.append(data[at:])
                    kept.append(b"".join(out))
                    n.append(len(data))
                    removed.append(count)
                    spans.append(len(joined))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, removed, spans))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = texts.join(gone, texts["doc_id"].eqNullSafe(gone["d"]) & (texts["version"] == gone["of"]), "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(trimmed(keep), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
