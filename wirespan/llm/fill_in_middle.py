"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix between units, and rearranged around sentinels.

Each text becomes an array of code points. Neighbouring code points of certain classes have a boundary between them; two
boundaries, chosen by a hash of the document's id, end prefix and middle. Nothing depends on other rows, on partitions or
on a random state, so reruns agree and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, unused

#: A batch of rows is sent on once it holds so many bytes.
BATCH_BYTES = 16 << 20
UNITS = ("line", "word", "char")
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        overlap = any(a.endswith(b[:k]) for a in marks for b in marks for k in range(1, len(b)))
        if not all(marks) or overlap or any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j):
            raise ValueError(f"sentinels must be non-empty, none within another, none starting as one ends: {marks}")


def boundaries(codes: np.ndarray, unit: str = "line") -> np.ndarray:
    """Ascending places between the units of an array of code points: n + 1 of them, from 0 to its length; 0 alone if empty.

    A line ends after its line feed, a word after the blanks that follow it, and what is left at the end is a unit too.
    """
    if not codes.size:
        return np.zeros(1, np.int64)
    if unit == "char":
        return np.arange(codes.size + 1)
    if unit == "line":
        ends = codes[:-1] == 10
    else:
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        ends = blank[:-1] & ~blank[1:]
    return np.concatenate([[0], np.flatnonzero(ends) + 1, [codes.size]])


def _arranged(text: str, ranks: list[int], spm: bool, plain: bool, unit: str, marks: Sentinels) -> tuple:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    places = boundaries(codes, unit)
    n = len(places) - 1
    if plain or not text or marks.prefix in text or marks.suffix in text or marks.middle in text:
        return n, "plain", None, None, text
    first, second = sorted(int(places[r % (n + 1)]) for r in ranks)
    prefix, middle, suffix = (piece.tobytes().decode("utf-32-le") for piece in (codes[:first], codes[first:second], codes[second:]))
    if spm:
        return n, "spm", first, second - first, f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}"
    return n, "psm", first, second - first, f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: str = "7", sentinels: Sentinels = Sentinels()) -> DataFrame:
    """The documents, all columns, and n (units of the text), form, prefix_chars, middle_chars, output, in place of columns
    of these names.

    h1 to h4 are the first four 8-digit groups of the hexadecimal sha256 of seed, ':' and doc_id. The prefix ends after the
    smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. Texts with h3 % 100 >= rate, empty ones and
    those that hold a sentinel are plain: output is the text, prefix_chars and middle_chars are null. Of the others, those
    with h4 % 100 < spm_rate are spm (suffix, prefix, middle), the rest psm (prefix, suffix, middle).

    A null text counts as empty (output is empty), a null doc_id as an empty string. Rows that repeat are each transformed,
    alike. Whole texts are cut; a task holds one text and its code points, besides a batch of bounded bytes.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    docs = docs.drop(*ADDED)
    whole, h = unused([*docs.columns, *ADDED], "whole", "ranks")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    ranks = F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))
    rows = docs.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias(whole), ranks.alias(h))
    kept = docs.columns

    def arrange(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch_of(part, out: list[tuple]):
            columns = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays([part.column(k) for k in range(len(kept))] + columns, [*kept, *ADDED])

        for part in slices(batches):
            texts, hashes = part.column(len(kept)), part.column(len(kept) + 1).to_pylist()
            out, size, start = [], 0, 0
            for i, (h1, h2, h3, h4) in enumerate(hashes):
                out.append(_arranged(texts[i].as_py(), [h1, h2], h4 % 100 < spm_rate, h3 % 100 >= rate, unit, sentinels))
                size += 4 * len(out[-1][-1])
                if size >= BATCH_BYTES:
                    yield batch_of(part.slice(start, len(out)), out)
                    out, size, start = [], 0, i + 1
            if out:
                yield batch_of(part.slice(start, len(out)), out)

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + ", ".join(f"{k} {v}" for k, v in ADDED.items())
    return rows.mapInArrow(arrange, schema)


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an output of fill_in_middle was made of, from output and form alone.

    A text with a form other than plain holds no sentinel, and sentinels neither overlap nor hold one another, so the first
    place of each is the one that was put in.
    """
    quoted = lambda mark: "\\Q" + mark.replace("\\E", "\\E\\\\E\\Q") + "\\E"

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.split(F.substring(output, len(first) + 1, 2**31 - 1), quoted(second), 2)
        tail = F.split(F.get(head, F.lit(1)), quoted(sentinels.middle), 2)
        return F.get(head, F.lit(0)), F.get(tail, F.lit(0)), F.get(tail, F.lit(1))

    prefix, suffix, middle = pieces(sentinels.prefix, sentinels.suffix)
    s, p, m = pieces(sentinels.suffix, sentinels.prefix)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(p, m, s)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of fill_in_middle's rows."""
    rows = fill_in_middle(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: digests in DuckDB.
SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS g, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l FROM documents),
ranked AS (SELECT *, len(l) AS n, ('0x' || g[1:8])::BIGINT % (len(l) + 1) AS x, ('0x' || g[9:16])::BIGINT % (len(l) + 1) AS y, ('0x' || g[17:24])::BIGINT AS h3, ('0x' || g[25:32])::BIGINT AS h4 FROM cut),
pieces AS (
  SELECT *, coalesce(array_to_string(list_filter(l, lambda u, i: i <= least(x, y)), ''), '') AS p,
    coalesce(array_to_string(list_filter(l, lambda u, i: i > least(x, y) AND i <= greatest(x, y)), ''), '') AS m,
    coalesce(array_to_string(list_filter(l, lambda u, i: i > greatest(x, y)), ''), '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM ranked)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM pieces
"""
