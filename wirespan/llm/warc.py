"""WARC archives: records compressed one by one with a Zstandard dictionary that leads the file in a skippable frame.

A task writes one archive. It builds the dictionary from the archive's own first records, writes it as a skippable frame
(readers without dictionaries skip it), then a warcinfo record and the records, each a frame of its own, so any record can
be read by its offset. Equal payloads are stored once: one record is a response, the others refer to it as revisits.

Tasks name their archives apart from one another and return a row for each record. These rows are the index, a Parquet
table committed by Spark; archives that it does not name, left by lost or repeated tasks, are never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, slices, stored

#: Fixed by the formats: magic numbers of a frame, a skippable frame (the one for dictionaries) and a dictionary.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of at least so many bytes are stored once.
MIN_BYTES = 100
DICTIONARY_BYTES = 64 << 10
#: An archive's dictionary is built from its first records up to so many bytes. It changes sizes alone, never records.
SAMPLE_BYTES = 4 << 20
LEVEL = 3
#: Of all records, as the rows hold no time of capture.
DATE = "1970-01-01T00:00:00Z"
READ_BYTES = 1 << 20
BATCH_BYTES = 16 << 20

INDEX_SCHEMA = "file string, offset long, length long, record_id string, record_type string"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload (binary, null for revisits), payload_bytes, payload_digest, refers_to (null for responses).

    Of rows with equal payloads of at least min_bytes the one with the smallest page_id is the response (ties: url, null
    first) and the others refer to it. Rows that repeat the response's page_id and url, smaller payloads and rows with a
    null page_id, which nothing could refer to, are all responses. A null html is an empty payload.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    place = F.struct("page_id", "url")
    alike = (F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()
    first = rows.filter(alike).groupBy("payload_digest").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    # Written, so that its size is known: it is small unless many pages repeat, and then payloads need not be shuffled.
    rows = rows.join(stored(first, "payloads"), "payload_digest", "left")
    revisit = alike & F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first"))
    return rows.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_to_url"),
    )


def _uri(url: str) -> str:
    """url with its control characters, blanks, '%' and what is not ASCII escaped, so that it stays on one line and can be read back."""
    return quote(url, safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%"))


def _record(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes, date: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, refers_to_url: str | None, date: str = DATE) -> tuple[str, str, bytes]:
    """Record id, type and bytes of a page's record. The id names the page; without page_id it is made of url and payload."""
    name = uuid.UUID(hashlib.sha256(f"{url!r} {digest}".encode()).hexdigest()[:32])
    record_id = f"urn:uuid:{name}" if page_id is None else f"urn:page:{page_id}"
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Target-URI", None if url is None else _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Refers-To-Target-URI", None if refers_to_url is None else _uri(refers_to_url)), ("WARC-Refers-To-Date", date)]
    fields += [("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record_id, kind, _record(kind, record_id, fields, http + (payload or b""), date)


def built_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A Zstandard dictionary of at most size bytes; None where the samples are too few or too small to build one."""
    import zstandard

    if sum(map(len, samples)) < 8 * 1024 or len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE, level: int = LEVEL, dictionary_bytes: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES) -> None:
    """Writes a record for each row of pages (page_id, url, html) to path/archives, a URI that all executors share, and the
    index of records to path/index. Rows are treated as with_revisits says; a url's unprintable characters are escaped.

    An archive holds what a task reads: spark.sql.files.maxPartitionBytes or AQE's advisory size. A task holds the sample
    for its dictionary and one record besides. An empty table gives an index without rows.
    """
    archives = f"{path}/archives"

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        def records() -> Iterator:
            for batch in slices(batches, 64):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield page_record(*row, date)

        ahead, size, rest = [], 0, records()
        for one in rest:
            ahead.append(one)
            size += len(one[2])
            if size >= sample_bytes:
                break
        if not ahead:
            return
        raw = built_dictionary([data for _, _, data in ahead], dictionary_bytes)
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
        compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)
        files, folder = _filesystem(archives)
        files.create_dir(folder, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        info = "software: wirespan\r\nformat: WARC File Format 1.1\r\n".encode()
        lead = _record("warcinfo", f"urn:uuid:{uuid.uuid4()}", [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info, date)
        at, rows = 0, []

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["file", "offset", "length", "record_id", "record_type"])
            rows.clear()
            return out

        with files.open_output_stream(f"{folder}/{name}", compression=None) as out:
            if raw:
                packed = zstandard.ZstdCompressor(level=19).compress(raw)
                at += out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
            at += out.write(compressor.compress(lead))
            while ahead or rest:
                for record_id, kind, data in ahead or rest:
                    frame = compressor.compress(data)
                    out.write(frame)
                    rows.append((name, at, len(frame), record_id, kind))
                    at += len(frame)
                    if len(rows) == 4096:
                        yield sent()
                rest, ahead = (None, []) if not ahead else (rest, [])
        if rows:  # after the archive is closed: an index row never precedes its bytes
            yield sent()

    with_revisits(pages, min_bytes).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "refers_to_url").mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{path}/index")


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, from an open binary stream; reads in pieces and holds one record."""
    import zstandard

    data, dictionary, decompressor = b"", None, None

    def more(n: int) -> bytes:
        nonlocal data
        while len(data) < n:
            got = stream.read(max(READ_BYTES, n - len(data)))
            if not got:
                break
            data += got
        return data

    while len(more(8)) >= 4:
        magic = struct.unpack_from("<I", data)[0]
        if SKIPPABLE & ~0xF == magic & ~0xF:
            size = struct.unpack_from("<I", data, 4)[0]
            body, data = more(8 + size)[8 : 8 + size], data[8 + size :]
            if magic == SKIPPABLE and dictionary is None:
                raw = zstandard.ZstdDecompressor().decompress(body) if body[:4] == struct.pack("<I", FRAME) else body
                dictionary = zstandard.ZstdCompressionDict(raw)
            continue
        decompressor = decompressor or zstandard.ZstdDecompressor(dict_data=dictionary)
        one, out = decompressor.decompressobj(), []
        while True:
            out.append(one.decompress(data))
            data = one.unused_data if one.eof else stream.read(READ_BYTES)
            if one.eof:
                break
            if not data:
                raise ValueError("an archive ends within a record")
        yield b"".join(out)
    if data:
        raise ValueError("an archive ends within a frame")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record, names in lower case, and its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('warc-record-id')}: its length is not {size}")
    return fields, rest[:size]


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _row(record: bytes) -> tuple | None:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of a page's record, else None. Digests
    and lengths of responses are those of the bytes there and must equal what the record states."""
    fields, block = parsed(record)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['warc-record-id']}: its payload is not what it states")
    url = fields.get("warc-target-uri")
    return _page(fields["warc-record-id"]), None if url is None else unquote(url), size, digest, kind, _page(fields.get("warc-refers-to")), payload if kind == "response" else None


def _batches(rows: Iterator[tuple], payloads: bool) -> Iterator:
    """Arrow batches of rows, each of bounded bytes."""
    import pyarrow as pa

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 7 if payloads else 6]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    out, size = [], 0
    for row in chain(rows, [None]):
        if row is not None:
            out.append(row if payloads else row[:6])
            size += 200 + (len(row[6] or b"") if payloads else 0)
        if out and (row is None or size >= BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=False)], names)
            out, size = [], 0


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORD_SCHEMA, and payload (binary, null for revisits) unless left out, of each page's record in the archives that
    the index names, each read whole and in order. payload_bytes and payload_digest are those of the full payload."""
    archives = f"{path}/archives"

    def read(batches: Iterator) -> Iterator:
        files, folder = _filesystem(archives)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    with files.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                        yield from filter(None, map(_row, frames(stream)))

        yield from _batches(rows(), payloads)

    names = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index").select("file").distinct()
    return names.mapInArrow(read, RECORD_SCHEMA + (", payload binary" if payloads else ""))


def read_records(index: DataFrame, path: str) -> DataFrame:
    """RECORD_SCHEMA and payload of the records that rows of an index name; only their frames and dictionaries are read."""
    archives = f"{path}/archives"

    def read(batches: Iterator) -> Iterator:
        import zstandard

        files, folder = _filesystem(archives)

        def rows() -> Iterator[tuple]:
            last, stream, decompressor = None, None, None
            for batch in batches:
                for name, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if name != last:
                        last, stream, decompressor = name, files.open_input_file(f"{folder}/{name}"), None
                        magic, size = struct.unpack("<II", stream.read_at(8, 0))
                        raw = stream.read_at(size, 8) if magic == SKIPPABLE else b""
                        raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == struct.pack("<I", FRAME) else raw
                        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
                    yield _row(decompressor.decompress(stream.read_at(length, offset)))

        yield from _batches(rows(), True)

    return index.select("file", "offset", "length").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD_SCHEMA + ", payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder and returns what reading them back gives, without payloads."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, payloads=False)


#: round_trip in DuckDB.
SQL = f"""
WITH paid AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, url, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM paid),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM sized WHERE payload_bytes >= {MIN_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id <> first_id THEN first_id END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
"""
