"""The pN queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import langid, leaks, mojibake, oracles, packing, reading
from lodestack.llm.neardup import NearDuplicates
from lodestack.session import materialize, table


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        reading.readings(table(spark, sf_dir, "name_record"), "name_lower", "name_id", "name_lower")
        .unionByName(reading.readings(table(spark, sf_dir, "content_store"), "text", "row_id", "text"))
        .unionByName(reading.list_readings(table(spark, sf_dir, "query_log"), "terms", "query_id", "terms"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.same_reading_pairs(_readings(spark, sf_dir))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names, texts and terms in their one form."""
    return (
        reading.canonical_rows(table(spark, sf_dir, "name_record"), "name_lower", "name_id", "name_lower")
        .unionByName(reading.canonical_rows(table(spark, sf_dir, "content_store"), "text", "row_id", "text"))
        .unionByName(reading.canonical_rows(table(spark, sf_dir, "query_log"), "terms", "query_id", "terms"))
    )


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_groups(_readings(spark, sf_dir))


def _copies(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(table(spark, sf_dir, "content_store"), n=4, threshold=0.6)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).row_pairs()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).groups()


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # where a record comes from: the volume and first folder of its path
    source = F.substring_index("path", "/", 4).alias("source")
    texts = table(spark, sf_dir, "content_store").select(F.lit("text").alias("src_field"), F.col("row_id").alias("rec_id"), "text", source)
    names = table(spark, sf_dir, "name_record").select(F.lit("name").alias("src_field"), F.col("name_id").alias("rec_id"), F.col("name").alias("text"), source)
    rows = texts.unionByName(names)
    return mojibake.restored(rows, mojibake.learn(rows, table(spark, sf_dir, "lang_sample")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("src_field", "rec_id").distinct()


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir)


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_spec"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing, counted over all documents."""
    specs = [(r.spec_id, r.capacity_tokens) for r in table(spark, sf_dir, "pack_spec").select("spec_id", "capacity_tokens").distinct().collect()]
    lengths = materialize(packing.token_lengths(table(spark, sf_dir, "documents")), "lengths")
    return packing.packing_invariants(materialize(packing.pack(lengths, specs), "packed"), lengths, specs)


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment score and longest run of every document that shares a seed with an item."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = langid.train(table(spark, sf_dir, "lang_sample"))
    return langid.wrong_labels(table(spark, sf_dir, "documents"), net)


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the languages it speaks."""
    net = langid.train(table(spark, sf_dir, "lang_sample"))
    return langid.document_languages(table(spark, sf_dir, "documents"), net)


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = langid.train(table(spark, sf_dir, "lang_sample"))
    return langid.language_segments(table(spark, sf_dir, "documents"), net)


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_forms, p3_groups, p4_found, p4_groups, p5_found, p5_restored, p6_packing, p6_invariants, p7_found, p7_scores, p8_found, p8_documents,
        p8_segments,
    )
}
SQL = oracles.SQL
