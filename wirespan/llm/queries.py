"""The queries of the training-data operators, each over its whole table, and their SQL where it can be expressed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .vectors import exact_top_k, quantised

    return exact_top_k(quantised(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    packed = pack_documents(_table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(_table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import checksums, round_trip

    return checksums(round_trip(_table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY)))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .repeats import dedup_substrings

    kept = dedup_substrings(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .vectors import nearest_lists, valid

    rows = valid(_table(spark, sf_dir, "embeddings")).filter(F.exists("v", lambda x: x != 0))
    return nearest_lists(rows, F.col("vec_id") % 20 == 0)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import tamper_check

    return tamper_check(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import digests

    return digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_top_k, op2_best_fit_packing, op3_source_mixing, op4_token_output, op5_suffix_array_dedup, op6_nearest_neighbours, op7_quality_classifier, op8_line_dedup, op9_ngram_jaccard_join, op10_html_extraction, op11_warc, op12_merkle_manifest, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    from . import fill_in_middle, line_dedup, merkle, mixing, warc

    return {"op3_source_mixing": mixing.SQL, "op8_line_dedup": line_dedup.SQL, "op11_warc": warc.SQL, "op12_merkle_manifest": merkle.SQL, "op13_fill_in_middle": fill_in_middle.SQL}
