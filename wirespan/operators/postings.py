"""A stored text index: postings in blocks, read by term, and ranked search that passes over blocks that can't matter.

Steps are numbered as they are written; a block holds a term's steps among BLOCK consecutive numbers, so no group of rows
grows with the corpus. Blocks are partitioned by bucket of the term and sorted by term, so a search reads one bucket for
each of its words and, by row-group statistics, little else of it. Numbers and places ascend within a block and are
delta-coded by Parquet. A block states its highest frequency and smallest length, which bound the score of any step in it.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.operators.search import B, COLUMNS, FIELDS, K1, fold_terms, WORD

BUCKETS = 32
#: Steps numbered consecutively that share a block.
BLOCK = 4096
#: A place is its column's number times this, and the word's number in the column.
WIDE = 1 << 40
#: Blocks with the highest bounds, searched first for a threshold.
FIRST = 8
#: So many surviving blocks at most are named in a pushed filter; more are found by a join.
NAMED = 1000
#: Version 2 pages without dictionaries: ascending numbers are stored as differences.
WRITER = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#term": "true", "compression": "zstd"}


def numbered(steps: DataFrame, segment: str) -> DataFrame:
    """steps with segment and doc, a number that ascends within a task; write them before they are read for an index."""
    return steps.withColumns({"segment": F.lit(segment), "doc": F.monotonically_increasing_id()})


def documents(steps: DataFrame, keys: list[str]) -> DataFrame:
    """segment, doc, keys, size (words of the indexed columns) of the numbered steps that have words."""
    return steps.select("segment", "doc", *keys, F.size(_words()).cast("long").alias("size")).filter("size > 0")


def _words() -> Column:
    texts = [F.array_join("tool_names", " ") if c == "tool_name" else F.col(c) for c in COLUMNS]
    found = [F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(WORD), F.lit(0)) for t in texts]

    def placed(words: Column, column: int) -> Column:
        return F.transform(words, lambda x, i: F.struct((F.lit(column * WIDE) + i).alias("place"), x.alias("term")))

    return F.concat(*(placed(w, k) for k, w in enumerate(found)))


def blocks(steps: DataFrame, stem: bool = True) -> DataFrame:
    """segment, bucket, term, block, n, max_tf, min_size, entries (off, size, tf) and places of each, of numbered steps.

    off is the step's number within the block. One shuffle deals words by term and block; both aggregations follow it.
    """
    words = _words()
    rows = steps.select("segment", "doc", words.alias("words")).withColumn("size", F.size("words")).select("segment", "doc", "size", F.inline("words"))
    rows = fold_terms(rows) if stem else rows
    dealt = rows.withColumn("block", F.floor(F.col("doc") / BLOCK)).repartition("segment", "term", "block")
    each = dealt.groupBy("segment", "term", "block", "doc").agg(F.sort_array(F.collect_list("place")).alias("places"), F.first("size").alias("size"))
    off = (F.col("doc") - F.col("block") * BLOCK).cast("int").alias("off")
    found = each.groupBy("segment", "term", "block").agg(F.sort_array(F.collect_list(F.struct(off, "size", F.size("places").alias("tf"), "places"))).alias("found"))
    return found.select(
        "segment", "term", "block", F.size("found").cast("long").alias("n"), F.array_max(F.transform("found", lambda x: x["tf"])).alias("max_tf"), F.array_min(F.transform("found", lambda x: x["size"])).alias("min_size"),
        F.transform("found", lambda x: F.struct(x["off"].alias("off"), x["size"].alias("size"), x["tf"].alias("tf"))).alias("entries"), F.transform("found", lambda x: x["places"]).alias("places"), bucket(F.col("term")).alias("bucket"),
    )


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def laid_out(found: DataFrame, partitions: int) -> DataFrame:
    """blocks as they are written (partitioned by bucket, with the options WRITER): ranges, so that a frequent term is split."""
    order = ["bucket", "term", "segment", "block"]
    return found.repartitionByRange(partitions, *order).sortWithinPartitions(*order)


@dataclass
class Index:
    """postings: rows of blocks; n and words: steps with words, and their words, in the whole index. dirty: segments in which
    some steps no longer count, whose steps that do are in live (segment, doc); others count whole."""

    postings: DataFrame
    n: int
    words: int
    dirty: tuple[str, ...] = ()
    live: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def of(self, words: list[str]) -> DataFrame:
        """The blocks of some terms; the plan prunes buckets and pushes the terms down."""
        known = F.lit(False)
        for w in dict.fromkeys(words):
            known = known | ((F.col("bucket") == bucket(F.lit(w))) & (F.col("term") == w))
        return self.postings.filter(known)

    def _counting(self, rows: DataFrame) -> DataFrame:
        if not self.dirty:
            return rows
        kept = rows.filter(F.col("segment").isin(*self.dirty)).join(self.live.select("segment", "doc"), ["segment", "doc"], "left_semi")
        return rows.filter(~F.col("segment").isin(*self.dirty)).unionByName(kept)

    def hits(self, phrases: list[list[str]], field: str = "all") -> DataFrame:
        """segment, doc, size, phrase (number), tf: how often each phrase occurs in the field of each step that counts."""
        doc = (F.col("block") * BLOCK + F.col("e.off")).alias("doc")
        out = None
        for i, phrase in enumerate(phrases):
            if len(phrase) == 1 and field == "all":
                own = self.of(phrase).select("segment", "block", F.explode("entries").alias("e")).select("segment", doc, F.col("e.size").alias("size"), F.lit(i).alias("phrase"), F.col("e.tf").cast("long").alias("tf"))
            else:
                columns = [COLUMNS.index(c) for c in FIELDS[field]]
                at = None
                for k, word in enumerate(phrase):
                    then = self.of([word]).select("segment", "block", F.explode(F.arrays_zip("entries", "places")).alias("x")).select("segment", "block", F.col("x.entries").alias("e"), F.explode("x.places").alias("place"))
                    then = then.filter(F.floor(F.col("place") / WIDE).isin(columns)).select("segment", doc, F.col("e.size").alias("size"), (F.col("place") - k).alias("place"))
                    at = then if at is None else at.join(then.select("segment", "doc", "place"), ["segment", "doc", "place"], "left_semi")
                own = at.groupBy("segment", "doc").agg(F.first("size").alias("size"), F.count("*").alias("tf")).select("segment", "doc", "size", F.lit(i).alias("phrase"), "tf")
            out = own if out is None else out.unionByName(own)
        return self._counting(out)

    def _idf(self, df: Column) -> Column:
        value = F.log((F.lit(self.n) - df + 0.5) / (df + 0.5))
        return F.when(value > 0, value).otherwise(F.lit(1e-6))

    def _part(self, tf: Column, size: Column) -> Column:
        mean = self.words / max(self.n, 1)
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))

    def scores(self, phrases: list[list[str]], field: str = "all") -> DataFrame:
        """segment, doc, score of every step in whose field each phrase occurs; lower scores are better."""
        found = self.hits(phrases, field)
        rare = found.groupBy("phrase").agg(F.count("*").alias("df"))  # a row a phrase
        part = self._idf(F.col("df")) * self._part(F.col("tf"), F.col("size"))
        each = found.join(F.broadcast(rare), "phrase").groupBy("segment", "doc").agg(*(F.max(F.when(F.col("phrase") == i, part)).alias(f"p{i}") for i in range(len(phrases))))
        return _summed(each, len(phrases))

    def best(self, words: list[str], k: int) -> Selection:
        """What a search for the k best steps that hold every word reads: see Selection."""
        weight, names = Counter(words), list(dict.fromkeys(words))
        meta = self.of(names).select("segment", "term", "block", "n", "max_tf", "min_size")
        df = {r.term: r.df for r in meta.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a word
        idf = {w: weight[w] * (x if df.get(w) and (x := math.log((self.n - df[w] + 0.5) / (df[w] + 0.5))) > 0 else 1e-6) for w in names}
        value = F.lit(0.0)
        for w in names:
            value = F.when(F.col("term") == w, F.lit(idf[w])).otherwise(value)
        bounds = meta.groupBy("segment", "block").agg(F.sum(value * self._part(F.col("max_tf"), F.col("min_size"))).alias("bound"), F.count("*").alias("c")).filter(F.col("c") == len(names)).drop("c")
        first = [(r.segment, r.block) for r in bounds.orderBy(F.desc("bound"), "segment", "block").limit(FIRST).collect()]
        leading = self._named(names, idf, first)
        top = leading.orderBy("score").limit(k).collect()
        reached = -top[-1].score if len(top) == k else 0.0
        # Bounds are sums of the same terms as scores but may be rounded otherwise.
        rest = bounds.filter((F.col("bound") >= reached * (1 - 1e-9)) & ~_among(first)).select("segment", "block")
        return Selection(bounds, first, reached, rest, leading, lambda chosen: self._scored(names, idf, self.of(names).join(chosen, ["segment", "block"], "left_semi")), lambda named: self._named(names, idf, named))

    def _named(self, names: list[str], idf: dict[str, float], chosen: list[tuple]) -> DataFrame:
        return self._scored(names, idf, self.of(names).filter(_among(chosen)))

    def _scored(self, names: list[str], idf: dict[str, float], rows: DataFrame) -> DataFrame:
        each = rows.select("segment", "term", "block", F.explode("entries").alias("e"))
        part = lambda w: F.lit(idf[w]) * self._part(F.col("e.tf"), F.col("e.size"))
        doc = (F.col("block") * BLOCK + F.col("e.off")).alias("doc")
        return _summed(each.groupBy("segment", doc).agg(*(F.max(F.when(F.col("term") == w, part(w))).alias(f"p{i}") for i, w in enumerate(names))), len(names))

    def top(self, words: list[str], k: int) -> DataFrame:
        """segment, doc, score of the k best steps that hold every word, and of all that tie with the last of them.

        Blocks whose bound is under the kth score of the first blocks searched are left out. Segments must count whole.
        """
        if self.dirty:
            raise ValueError("blocks of segments in which some steps no longer count have no exact frequencies")
        if not words or k < 1:
            return self._scored([""], {"": 0.0}, self.of([""])).limit(0)
        plan = self.best(words, k)
        some = plan.rest.limit(NAMED + 1).collect()
        found = plan.leading.unionByName(plan.named([tuple(r) for r in some]) if len(some) <= NAMED else plan.scored(plan.rest))
        kth = found.orderBy("score").limit(k).agg(F.max("score").alias("kth"))
        return found.crossJoin(F.broadcast(kth)).filter(F.col("score") <= F.col("kth")).drop("kth")


@dataclass
class Selection:
    """bounds: every block that holds all words, and its bound. first: those searched first, leading: their steps' scores,
    reached: the kth of these. rest: the others whose bound is not under it."""

    bounds: DataFrame
    first: list[tuple]
    reached: float
    rest: DataFrame
    leading: DataFrame
    scored: object
    named: object


def _among(chosen: list[tuple]) -> Column:
    by: dict[str, list[int]] = {}
    for segment, block in chosen:
        by.setdefault(segment, []).append(block)
    out = F.lit(False)
    for segment, found in by.items():
        out = out | ((F.col("segment") == segment) & F.col("block").isin(*found))
    return out


def _summed(each: DataFrame, n: int) -> DataFrame:
    """Parts added in one order, so that equal parts give equal scores; rows without one of them are left out."""
    total = F.col("p0")
    for i in range(1, n):
        total = total + F.col(f"p{i}")
    return each.select("segment", "doc", (-total).alias("score")).filter("score is not null")
