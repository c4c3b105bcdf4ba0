"""Line dedup over content-defined chunks of lines, with DataFrame functions alone.

Each line has a hash; a hash rolling over two line hashes decides whether a chunk ends between these lines. Of its values
those are boundaries whose first digit ends a chunk or whose second digit begins one, so where a passage starts or ends
between other lines, its own line can make the boundary whatever the neighbour is. Several such rolling hashes cut every
document several times, each about every two lines, and what any of them finds repeated goes. A chunk of two lines or more
that starts earlier anywhere (smaller doc_id, or same document, earlier line) is removed, after a comparison of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, release, stored, unused

#: Rolling hashes: the k-th takes the k-th hexadecimal digit of both lines' MD5.
HASHES = 12
#: A line begins a chunk where its digit is under BEGINS, and ends one where its digit is at least ENDS.
BEGINS, ENDS = 7, 9
MIN_LINES = 2
#: Longer chunks are cut after so many lines.
MAX_LINES = 32
#: A chunk is one number: its first line times this, plus the line after its last.
_WIDE = 1 << 31


def _chunks(hashes: Column, k: int) -> Column:
    """First lines and ends of the chunks of at least MIN_LINES lines that the k-th rolling hash makes."""
    digit = lambda i: F.shiftright(F.get(hashes, i), 4 * (HASHES - 1 - k)).bitwiseAND(15)
    inner = F.when(F.size(hashes) > 1, F.sequence(F.lit(1), F.size(hashes) - 1)).otherwise(F.array().cast("array<int>"))
    cuts = F.concat(F.array(F.lit(0)), F.filter(inner, lambda i: (digit(i - 1) >= ENDS) | (digit(i) < BEGINS)))
    ends = F.concat(F.slice(cuts, F.lit(2), F.size(cuts)), F.array(F.size(hashes)))
    pieces = F.flatten(F.zip_with(cuts, ends, lambda a, b: F.transform(F.sequence(a, b - 1, F.lit(MAX_LINES)), lambda x: x.cast("long") * _WIDE + F.least(x + MAX_LINES, b))))
    return F.filter(pieces, lambda x: x % _WIDE - F.shiftright(x, 31) >= MIN_LINES)


def _span(chunk: Column) -> tuple[Column, Column]:
    """From which line (from 1), and how many lines."""
    first = F.shiftright(chunk, 31)
    return (first + 1).cast("int"), (chunk % _WIDE - first).cast("int")


def chunk_keys(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), chunk, key (hash of its lines) of every chunk that is not of blank lines alone.
    Rows with the same doc_id and text give each chunk once for each row."""
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("version"), lines.alias("lines")).filter("lines is not null")
    number = lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, HASHES), 16, 10).cast("long")
    rows = rows.select("doc_id", "version", F.transform("lines", number).alias("h"), F.transform("lines", lambda x: F.xxhash64(x)).alias("x"), F.transform("lines", lambda x: F.trim(x) != "").alias("some"))
    each = F.array_distinct(F.concat(*(_chunks(F.col("h"), k) for k in range(HASHES))))
    rows = rows.select("doc_id", "version", "x", "some", F.explode(each).alias("chunk"))
    rows = rows.filter(F.exists(F.slice("some", *_span(F.col("chunk"))), lambda x: x))
    return rows.select("doc_id", "version", "chunk", F.xxhash64(F.slice("x", *_span(F.col("chunk")))).alias("key"))


def _texts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, version, chunk, key) with their text."""
    text = F.col("text").cast("string")
    own = chunks.groupBy(F.col("doc_id").alias("doc"), F.col("version").alias("of")).agg(F.collect_set(F.struct("chunk", "key")).alias("found"))
    rows = docs.select("doc_id", F.xxhash64(text).alias("version"), F.split(text, "\n", -1).alias("lines"))
    rows = rows.join(own, rows["doc_id"].eqNullSafe(own["doc"]) & (rows["version"] == own["of"])).select("doc_id", "version", "lines", F.explode("found").alias("c"))
    return rows.select("doc_id", "version", "c.chunk", "c.key", F.array_join(F.slice("lines", *_span(F.col("c.chunk"))), "\n").alias("text"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, version, chunk of each chunk whose lines start earlier anywhere.

    Hashes find what may repeat. The texts of chunks that share a hash are then grouped by their bytes: where they are one
    text, as ever but for collisions, chunks need no text any more to be told from the first; where they are several, each
    is told from the first with its own bytes.
    """
    spark, place = docs.sparkSession, F.struct("doc_id", "version", "chunk")
    rows = stored(chunk_keys(docs), "chunks")
    often = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    files = max(1, partitions(spark) // 8)  # rows of a few numbers
    rows = stored(rows.join(often, "key", "left_semi").coalesce(files), "repeated")
    release(spark)
    firsts = _texts(docs, rows).groupBy("key", "text").agg(F.min(place).alias("first"))
    firsts = stored(firsts.groupBy("key").agg(F.count("*").alias("texts"), F.min("first").alias("first")).coalesce(files), "firsts")
    release(spark)
    gone = rows.join(firsts.filter("texts = 1"), "key").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "version", "chunk")
    mixed = firsts.filter("texts > 1")
    if not mixed.isEmpty():
        texts = stored(_texts(docs, rows.join(mixed, "key", "left_semi")), "mixed")
        first = texts.groupBy("key", "text").agg(F.min(place).alias("first"))
        gone = gone.unionByName(texts.join(first, ["key", "text"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "version", "chunk"))
    return gone


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """The documents, all columns, less the lines of chunks that start earlier anywhere; chunks are judged on the input.
    n_chars, if there, follows a changed text.

    Null texts stay null; a text whose lines all repeat becomes empty. Rows with the same doc_id and text are one document;
    those with the same doc_id and another text are documents of their own; a null doc_id comes first. With counts, adds
    n_lines and n_removed_lines, in place of columns of these names.
    """
    spans = F.transform(F.col("chunks"), lambda c: F.sequence(F.shiftright(c, 31).cast("int"), (c % _WIDE).cast("int") - 1))
    gone = repeated_chunks(docs).groupBy("doc_id", "version").agg(F.collect_set("chunk").alias("chunks"))
    return _without(docs, gone.select("doc_id", "version", F.flatten(spans).alias("covered")), counts)


def _without(docs: DataFrame, gone: DataFrame, counts: bool) -> DataFrame:
    """docs without the lines that gone (doc_id, version, covered) numbers from 0."""
    if counts:
        docs = docs.drop("n_lines", "n_removed_lines")
    doc, of, of_doc, version, lines, left = unused(docs.columns, "doc", "of", "gone", "version", "lines", "kept")
    gone = gone.select(F.col("doc_id").alias(doc), F.col("version").alias(of), F.col("covered").alias(of_doc))
    text = F.col("text").cast("string")
    # Lines are split before the join, so that what picks them afterwards does not split the text for each line.
    rows = docs.select(*(c for c in docs.columns if c != "text"), F.xxhash64(text).alias(version), F.split(text, "\n", -1).alias(lines))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone[doc]) & (rows[version] == gone[of]), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), of_doc)
    rows = rows.withColumn(left, F.when(F.col(of_doc).isNull(), F.col(lines)).otherwise(F.transform(places, lambda i: F.get(lines, i))))
    new = F.array_join(left, "\n")
    columns = [new.alias("text") if c == "text" else F.when(F.col(of_doc).isNull(), F.col(c)).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    if counts:
        size = lambda c: F.when(F.col(lines).isNull(), 0).otherwise(F.size(c)).cast("long")
        columns += [size(lines).alias("n_lines"), (size(lines) - size(left)).alias("n_removed_lines")]
    return rows.select(*columns)


def _windows(text: Column, min_lines: int) -> Column:
    """For each run of min_lines lines, from its first, 65 characters for each line: b for a blank one or t, and digest."""
    digests = F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.when(F.trim(x) == "", "b").otherwise("t"), F.sha2(x.cast("binary"), 256)))
    runs = F.greatest(F.size(digests) - (min_lines - 1), F.lit(0))
    out = F.slice(digests, F.lit(1), runs)
    for k in range(1, min_lines):
        out = F.zip_with(out, F.slice(digests, F.lit(k + 1), runs), lambda x, y: F.concat(x, y))
    return out


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, version (hash of the text), i (first line, from 0) of each run of min_lines lines that starts earlier.

    Runs of blank lines alone never count.
    """
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("version"), F.posexplode(_windows(text, min_lines)).alias("i", "w"))
    some_text = F.lit(False)
    for k in range(min_lines):
        some_text = some_text | (F.substring("w", 65 * k + 1, 1) == "t")
    rows = stored(rows.filter(some_text).select("doc_id", "version", "i", F.unhex(F.sha2(F.col("w").cast("binary"), 256)).alias("w")), "runs")
    place = F.struct("doc_id", "version", "i")
    first = rows.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    return rows.join(first, "w").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "version", "i")


def dedup_passages(docs: DataFrame, min_lines: int = MIN_LINES, counts: bool = False) -> DataFrame:
    """The documents, all columns, less each line of a run of min_lines lines that starts earlier anywhere (smaller
    doc_id, or same document, earlier line); runs are judged on the input. n_chars, if there, follows a changed text.

    Null texts stay null; a text whose lines all repeat becomes empty. Rows with the same doc_id and text are one
    document; those with the same doc_id and another text are documents of their own; a null doc_id comes first. With
    counts, adds n_lines and n_removed_lines, in place of columns of these names.
    """
    gone = repeated_runs(docs, min_lines).groupBy("doc_id", "version").agg(F.collect_set("i").alias("runs"))
    covered = F.flatten(F.transform("runs", lambda i: F.sequence(i, i + (min_lines - 1))))
    return _without(docs, gone.select("doc_id", "version", covered.alias("covered")), counts)


#: dedup_lines with counts in DuckDB.
SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
digits AS (SELECT doc_id, i, line, k, ('0x' || substr(md5(line), k, 1))::INT AS d FROM lines, range(1, {HASHES + 1}) r(k)),
cut AS (SELECT *, CASE WHEN d < {BEGINS} OR lag(d) OVER w >= {ENDS} THEN 1 ELSE 0 END AS c FROM digits WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)),
numbered AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, k ORDER BY i) AS no FROM cut),
placed AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, k, no ORDER BY i) - 1) // {MAX_LINES} AS piece FROM numbered),
chunks AS (SELECT DISTINCT doc_id, first, n, chunk FROM (SELECT doc_id, min(i) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, k, no, piece)
  WHERE n >= {MIN_LINES} AND trim(replace(chunk, chr(10), '')) <> ''),
judged AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) > 1 AS gone FROM chunks),
removed AS (SELECT DISTINCT doc_id, unnest(range(first, first + n)) AS i FROM judged WHERE gone),
done AS (SELECT l.doc_id, count(*) AS n_lines, count(r.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE r.i IS NULL), '') AS text FROM lines l LEFT JOIN removed r ON r.doc_id = l.doc_id AND r.i = l.i GROUP BY 1)
SELECT d.doc_id, done.text AS text, coalesce(done.n_lines, 0)::BIGINT AS n_lines, coalesce(done.n_removed, 0)::BIGINT AS n_removed_lines
FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id
"""
