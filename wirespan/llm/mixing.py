"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets.

A source's target is its weight's share of all words, at most three times its own; what that frees is shared by weight
among the rest. The whole epochs in a target take every document; the fraction left takes documents in order of
exponential keys, -ln(u) / quality, while their running sum stays within the budget, and what then remains is filled
in the same order by documents that still fit. Running sums go through ranges of the key, even in rows whatever the
qualities are, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, unused

WEIGHTS = (5, 2, 1)
EPOCHS = 3
PASSES = 3
#: Characters that lower a document's quality weight.
MARKS = "#$%&*|!=_<>{}[]^~"

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """1 for plain text, less the larger its share of marks; null and empty texts have 1."""
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    return F.coalesce(1 / (1 + 20 * marks.cast("double") / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the doc_id, the same in every run."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target of each source of sizes (source, size): a few rows, however many documents.

    With sources by the ratio of limit to weight, the level of (words left) / (weights left) rises while limits bind and
    falls after, so its maximum is the level that shares all words.
    """
    case = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return sizes.sparkSession.sql(f"""
        WITH s AS (SELECT source, sum(size) AS source_size FROM {{sizes}} GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} {case} END AS w FROM s),
        r AS (SELECT *, {epochs} * source_size AS most,
                (sum(source_size) OVER () - coalesce(sum({epochs} * source_size) OVER before, 0)) / cast(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS double) AS level
              FROM w WINDOW before AS (ORDER BY {epochs} * source_size / cast(w AS double), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT source, source_size, least(cast(most AS double), max(level) OVER () * w) AS target FROM r""", sizes=sizes)


def _pass(rows: DataFrame, name: str) -> DataFrame:
    """rows with chosen raised by one for those not yet chosen that fit budget in key order, and budget less their sizes.

    rows: source, item, doc_id, key, bucket, size, chosen, budget. Each (source, bucket) is a group of its own.
    """
    open_ = (F.col("chosen") == 0) & (F.col("size") <= F.col("budget")) & (F.col("size") > 0)
    rows = rows.withColumn("counted", F.when(open_, F.col("size")).otherwise(F.lit(0)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("counted").alias("total"))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.expr("coalesce(sum(total) over (partition by source order by bucket rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    placed = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["bucket"] == sums["b"]))
    placed = placed.withColumn("upto", F.col("before") + F.expr("sum(counted) over (partition by source, bucket order by key, doc_id, item rows between unbounded preceding and current row)"))
    placed = placed.withColumn("now", open_ & (F.col("upto") <= F.col("budget")))
    now = stored(placed.select("source", "item", "doc_id", "key", "bucket", "size", (F.col("chosen") + F.col("now").cast("int")).alias("chosen"), "budget", "now"), name)
    spent = now.filter("now").groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("spent"))
    return now.join(spent, now["source"].eqNullSafe(spent["s"]), "left").withColumn("budget", F.col("budget") - F.coalesce("spent", F.lit(0))).drop("s", "spent", "now")


def mix_sizes(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """item, doc_id, size, source_size, target, copies of each row of sizes (item, doc_id, source, size, quality)."""
    goals = targets(sizes.select("source", "size"), weights, epochs)
    goals = stored(goals.select(F.col("source").alias("s"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("whole")), "mixing-targets")
    rows = sizes.withColumn("key", -F.log(uniform(F.col("doc_id"))) / F.col("quality"))
    budgets = goals.select("s", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    rows = rows.join(budgets, rows["source"].eqNullSafe(budgets["s"])).select("source", "item", "doc_id", "key", "size", F.lit(0).alias("chosen"), "budget")
    rows = rows.repartitionByRange(partitions(sizes.sparkSession), "source", "key", "doc_id", "item").withColumn("bucket", F.spark_partition_id())
    rows = stored(rows, "mixing-keys")
    for _ in range(PASSES):
        rows = _pass(rows, "mixing-pass")
    return rows.join(goals, rows["source"].eqNullSafe(goals["s"])).select("item", "doc_id", "size", "source_size", "target", (F.col("whole") + F.col("chosen")).alias("copies"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """item (unique), doc_id, source, size in words, quality weight."""
    text = F.col("text").cast("string")
    return docs.select(F.monotonically_increasing_id().alias("item"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), n_words(text).alias("size"), quality(text).alias("quality"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken (copies times size) of each document.

    Null and empty texts have size 0 and take nothing; a source of no words has target 0; a null source is a source,
    the last. Repeated rows are documents of their own. An empty table gives no rows.
    """
    mixed = mix_sizes(stored(document_sizes(docs), "mixing-sizes"), weights, epochs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it (not at all, or up to epochs times)."""
    item, copies, copy = unused(docs.columns, "item", "copies", "copy")
    rows = stored(docs.withColumn(item, F.monotonically_increasing_id()), "mixing-documents")
    text = F.col("text").cast("string")
    sizes = stored(rows.select(F.col(item).alias("item"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), n_words(text).alias("size"), quality(text).alias("quality")), "mixing-sizes")
    taken = mix_sizes(sizes, weights, epochs).filter("copies > 0").select(F.col("item").alias(item), F.col("copies").alias(copies))
    return rows.join(taken, item).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def _pass_sql(n: int) -> str:
    return f"""p{n} AS (
  SELECT * EXCLUDE (chosen, budget, upto, ok), chosen + (ok AND upto <= budget)::INT AS chosen,
    budget - coalesce(sum(size) FILTER (WHERE ok AND upto <= budget) OVER (PARTITION BY source), 0) AS budget
  FROM (SELECT *, sum(CASE WHEN ok THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
        FROM (SELECT *, chosen = 0 AND size <= budget AND size > 0 AS ok FROM p{n - 1})))"""


#: The same in DuckDB, for unique doc_ids.
SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    coalesce(1 / (1 + 20 * (length(text) - length(translate(text, '{MARKS}', '')))::DOUBLE / greatest(length(text), 1)), 1.0) AS quality FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, 3 * source_size AS most, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM w WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most::DOUBLE, max(level) OVER () * w) AS target FROM r),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) ELSE 0 END AS whole FROM t),
p0 AS (SELECT d.*, g.source_size, g.target, g.whole, 0 AS chosen, g.target - g.whole * g.source_size::DOUBLE AS budget,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(2**48)!r}) / quality AS key FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
{", ".join(_pass_sql(n) for n in range(1, PASSES + 1))}
SELECT doc_id, size, source_size::BIGINT AS source_size, target, ((whole + chosen) * size)::BIGINT AS taken FROM p{PASSES}
"""
