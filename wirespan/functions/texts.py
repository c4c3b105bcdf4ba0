"""Text functions: volatile fragments, error words, header masks, snippets, hashes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fragments of a system prompt that change from call to call, and what stands for them.
VOLATILE = (
    (r"Generated \d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "Generated [TIMESTAMP]"),
    (r"The user opened the file [^\s]+ in the IDE\.", "The user opened file in IDE."),
    (r"(?s)<system-reminder>.*?</system-reminder>", "[SYSTEM-REMINDER]"),
    (r"cch=[0-9a-f]+;?", "cch=[HASH];"),
)

#: Words that mark a tool's output as an error.
ERROR_WORDS = (
    "error", "errors", "errored", "exception", "traceback", "failed", "failure", "fatal", "not found", "no such file", "permission denied",
    "denied", "timed out", "timeout", "ENOENT", "EACCES", "ECONNREFUSED", "ETIMEDOUT", "stderr",
)

#: Header names, or parts of them, whose values are masked.
SENSITIVE_HEADERS = ("authorization", "x-api-key", "x-goog-api-key", "x-auth-token", "cookie", "set-cookie", "x-session-token", "x-access-token", "bearer", "proxy-authorization")


def without_volatile(text: Column) -> Column:
    for pattern, stands in VOLATILE:
        text = F.regexp_replace(text, pattern, F.lit(re.sub(r"([\\$])", r"\\\1", stands)))
    return text


def looks_errored(text: Column) -> Column:
    """Whether an error word stands in text by itself, in any case; words are bounded by ASCII letters, digits and _."""
    return F.coalesce(text.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(ERROR_WORDS)})(?![A-Za-z0-9_])"), F.lit(False))


def masked_header(name: Column, value: Column) -> Column:
    sensitive = F.lit(False)
    for part in SENSITIVE_HEADERS:
        sensitive = sensitive | F.lower(name).contains(part)
    n = F.length(value)
    mask = F.when(n > 14, F.concat(F.substring(value, 1, 10), F.lit("..."), F.right(value, F.lit(4)))).when(n > 4, F.concat(F.substring(value, 1, 2), F.lit("..."), F.right(value, F.lit(2)))).otherwise(F.lit("[REDACTED]"))
    return F.when(sensitive, mask).otherwise(value)


def masked_headers(headers: Column) -> Column:
    """A map of headers with the values of sensitive ones masked."""
    return F.transform_values(headers, masked_header)


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def last4(text: Column) -> Column:
    return F.when(F.length(text) >= 8, F.right(text, F.lit(4))).otherwise(F.lit(""))


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4 + 0.5).cast("long")


def flattened(text: Column, most: int) -> Column:
    """White space runs as one space, cut with an ellipsis to at most so many characters."""
    flat = F.trim(F.regexp_replace(text, r"[\s ]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def project_of(path: Column) -> Column:
    """The project folder of a log: the parent of its trace folder, else its own folder."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    return F.regexp_replace(folder, r"/\.(?:claude|codex|gemini)-trace$", "")


def sibling(path: Column, suffix: str) -> Column:
    """Path of a report beside a log: .html, .atif.json or .stats.json."""
    return F.concat(F.regexp_replace(path, r"\.jsonl$", ""), F.lit(suffix))


def snippet(text: Column, tokens: list[str], radius: int = 60) -> Column:
    """Part of text around the first of tokens, `radius` before and twice that after, every token in brackets."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]+", " ")
    if not tokens:
        return F.substring(flat, 1, 2 * radius)
    low = F.lower(flat)
    places = [F.instr(low, t.lower()) for t in tokens]
    first = F.array_min(F.filter(F.array(*places), lambda x: x > 0))
    start = F.greatest(F.coalesce(first, F.lit(1)) - radius, F.lit(1)).cast("int")
    size = F.coalesce(first, F.lit(1)) + 2 * radius - start
    part = F.substr(flat, start, size.cast("int"))
    shown = F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), part, F.when(start + size - 1 < F.length(flat), F.lit("…")).otherwise(F.lit("")))
    marked = "|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True))
    return F.regexp_replace(shown, f"(?i)({marked})", "[$1]")


#: Characters of a text hashed at once.
HASHED = 1 << 16


def djb2(text: Column) -> Column:
    """The 32-bit times-33-plus hash in lower-case hexadecimal, over UTF-16 units as scripts count them.

    Texts leave the Arrow batch one at a time, a piece at a time: a worker holds little besides the batch.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers = np.ones(2 * HASHED + 1, np.uint32)  # 33 ** k, modulo 2 ** 32
        np.multiply.accumulate(np.full(2 * HASHED, 33, np.uint32), out=powers[1:])

        def of(t: str) -> str:
            h = 5381
            for at in range(0, len(t), HASHED):
                units = np.frombuffer(t[at : at + HASHED].encode("utf-16-le", "surrogatepass"), "<u2")
                own = int(np.multiply(units, powers[len(units) - 1 :: -1][: len(units)], dtype=np.uint32).sum(dtype=np.uint64))
                h = (h * int(powers[len(units)]) + own) & 0xFFFFFFFF
            return format(h, "x")

        for texts in batches:
            yield pa.array([None if not t.is_valid else of(t.as_py()) for t in texts], pa.string())

    return run(text)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, bits a character; 0 for empty and null texts."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: sum(-k / len(t) * math.log2(k / len(t)) for k in Counter(t).values()) if t else 0.0).astype("float64")

    return run(text)


def _places(text: str, query: str) -> list[list[int]] | None:
    """For each word of query where its letters are first found in text, one after the other; None where one is not."""
    found, start = [], 0
    for word in query.split(" "):
        word_places = []
        for letter in word:
            place = text.find(letter, start)
            if place < 0:
                return None
            word_places.append(place)
            start = place + 1
        found.append(word_places)
    return found


def fuzzy_score(text: str, query: str) -> int:
    """Score of query as a subsequence of text, case aside; -1 where it is none.

    n letters of a word that are found next to each other score n (n + 1), and each letter found at the start, after a
    space or after a slash 4 more. Spaces in query only part its words.
    """
    text = text.lower()
    words = _places(text, query.lower())
    if words is None:
        return -1
    runs = [len(list(run)) for word in words for _, run in groupby(place - k for k, place in enumerate(word))]
    starts = sum(place == 0 or text[place - 1] in " /" for word in words for place in word)
    return sum(n * (n + 1) for n in runs) + 4 * starts


def fuzzy(text: Column, query: str) -> Column:
    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: fuzzy_score(t or "", query)).astype("int32")

    return run(text)
