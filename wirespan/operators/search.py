"""Ranked text search over steps: posting lists, phrases, BM25, snippets.

The index is a table of terms with places, partitioned by term in any later join; a query reads the rows of its terms.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.functions.texts import snippet
from wirespan.operators.sessions import filtered, has_tool

#: Indexed columns, and those that each field of a query covers.
COLUMNS = ("message", "reasoning", "tool_name", "tool_input", "observation")
FIELDS = {"all": COLUMNS, "message": ("message",), "reasoning": ("reasoning",), "tool-input": ("tool_name", "tool_input"), "tool-output": ("observation",)}
#: Order in which a hit's text is chosen for its snippet.
SHOWN = ("message", "observation", "tool_input", "reasoning", "tool_name")
K1, B = 1.2, 0.75
LIMIT = 20
#: A term, as the index splits lower-case text.
WORD = r"[\p{L}\p{N}]+"


def query_phrases(query: str, stem: bool = False) -> list[list[str]]:
    """Phrases of a query, all of which must match: each of its tokens, split into terms as the index splits text."""
    fold = lambda w: folded(w) if stem else w
    tokens = re.findall(r"[\w./@-]+", query)
    phrases = [[fold(w) for w in re.findall(r"[^\W_]+", t.lower())] for t in tokens]
    return [p for p in phrases if p]


def query_tokens(query: str) -> list[str]:
    """Distinct lower-case words of a query, to mark in snippets."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


_VOWEL = "aeiou"


def _consonant(word: str, i: int) -> bool:
    return word[i] not in _VOWEL and (word[i] != "y" or i == 0 or not _consonant(word, i - 1))


def _measure(stem: str) -> int:
    kinds = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _short_end(word: str) -> bool:
    return len(word) > 2 and _consonant(word, len(word) - 1) and not _consonant(word, len(word) - 2) and _consonant(word, len(word) - 3) and word[-1] not in "wxy"


#: Suffixes of Porter's published algorithm (1980), steps 2 to 4.
_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", bli="ble", logi="log")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize sion tion".split()


def porter(word: str) -> str:
    """Stem of a lower-case English word by Porter's algorithm; words with other letters stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _consonant(cut, len(cut) - 1) and cut[-1] not in "lsz":
            word = cut[:-1]
        else:
            word = cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = next((x for x in sorted(table, key=len, reverse=True) if word.endswith(x)), None)
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = next((x for x in sorted(_STEP4, key=len, reverse=True) if word.endswith(x)), None)
    if end:
        stem = word[: -len(end)] + (end[0] if end in ("sion", "tion") else "")
        if _measure(stem) > 1:
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def folded(word: str) -> str:
    """A word without diacritics, stemmed."""
    return porter("".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)))


def index_terms(steps: DataFrame, stem: bool = True) -> DataFrame:
    """session_id, step_index, col, pos, term of every word of the indexed columns."""
    rows = steps.withColumn("tool_name", F.array_join("tool_names", " "))
    texts = F.array(*(F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c), F.lit("")).alias("text")) for c in COLUMNS))
    rows = rows.select("session_id", "step_index", F.explode(texts).alias("t")).select("session_id", "step_index", "t.col", F.posexplode(F.regexp_extract_all(F.lower("t.text"), F.lit(WORD), F.lit(0))).alias("pos", "term"))
    return fold_terms(rows) if stem else rows


def fold_terms(rows: DataFrame) -> DataFrame:
    """rows with their column term folded."""

    @F.pandas_udf("string")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map({w: folded(w) for w in words.unique()})

    return rows.withColumn("term", fold("term"))


def scores(terms: DataFrame, phrases: list[list[str]], field: str = "all") -> DataFrame:
    """session_id, step_index, score of the steps in whose field every phrase occurs; lower scores are better.

    BM25 with k1 1.2 and b 0.75 over the whole index: frequencies count phrases, lengths all words of a step, and an
    inverse document frequency that would not be positive is one millionth.
    """
    sizes = terms.groupBy("session_id", "step_index").agg(F.count("*").alias("size"))
    corpus = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    scope = terms.filter(F.col("col").isin(*FIELDS[field]))
    hits = None
    for i, phrase in enumerate(phrases):
        at = scope.filter(F.col("term") == phrase[0]).select("session_id", "step_index", "col", "pos")
        for k, word in enumerate(phrase[1:], 1):
            then = scope.filter(F.col("term") == word).select("session_id", "step_index", "col", (F.col("pos") - k).alias("pos"))
            at = at.join(then, ["session_id", "step_index", "col", "pos"], "left_semi")
        own = at.groupBy("session_id", "step_index").agg(F.count("*").alias("tf")).withColumn("phrase", F.lit(i))
        hits = own if hits is None else hits.unionByName(own)
    rare = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    rows = hits.join(F.broadcast(rare), "phrase").join(sizes, ["session_id", "step_index"]).crossJoin(F.broadcast(corpus))
    return rows.groupBy("session_id", "step_index").agg((-F.sum(part)).alias("score"), F.count("*").alias("found")).filter(F.col("found") == len(phrases)).drop("found")


def search(steps: DataFrame, sessions: DataFrame, query: str, *, field: str = "all", limit: int | None = LIMIT, role: str | None = None, tool: str | None = None, errored: bool = False, stem: bool = True, found: DataFrame | None = None, **filters) -> DataFrame:
    """The best hits of query with their session's columns and a snippet, score first, ties by session and step.

    limit: how many, or None for all hits. found: session_id, step_index, score from a stored index of the same steps, which
    need not hold more than the limit's hits if nothing else filters them. filters: as sessions.filtered takes them.
    """
    if found is None:
        found = scores(index_terms(steps, stem), query_phrases(query, stem) or [["\0"]], field)
    rows = steps.join(found, ["session_id", "step_index"]).join(filtered(sessions, **filters), "session_id")
    if role:
        rows = rows.filter(F.col("role") == role)
    if tool:
        rows = rows.filter(has_tool(tool))
    if errored:
        rows = rows.filter("errored")
    rows = rows.orderBy("score", "session_id", "step_index")
    rows = (rows if limit is None else rows.limit(limit)).withColumn("tool_name", F.array_join("tool_names", " "))
    order = FIELDS[field] if field != "all" else SHOWN
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    name, text = F.lit(order[-1]), F.col(order[-1])
    for c in reversed(order[:-1]):
        name, text = F.when(~blank(c), F.lit(c)).otherwise(name), F.when(~blank(c), F.col(c)).otherwise(text)
    return rows.withColumn("snippet_field", name).withColumn("snippet", snippet(text, query_tokens(query)))
