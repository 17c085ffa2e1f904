"""Pairs of rows whose values differ in characters but read the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.forms import canonical_column, skeleton_column
from lodestack.session import materialize

SALTS = 16
#: Spellings of one reading that one task compares with the others.
SPELLINGS = 2048


def canonical_rows(rows: DataFrame, field: str, id_col: str, value_col: str) -> DataFrame:
    """``(src_field, id, form)``: each value in its one consistent form, null values as null.

    Lists (of strings) come out as one text, their elements joined by a bar; a
    null element is left out.  Null ids are left out.
    """
    value = F.col(value_col)
    if rows.schema[value_col].dataType.typeName() == "array":
        value = F.array_join(value, "|")
    return rows.where(F.col(id_col).isNotNull()).select(F.lit(field).alias("src_field"), F.col(id_col).cast("bigint").alias("id"), canonical_column(value).alias("form"))


def reading_groups(rows: DataFrame) -> DataFrame:
    """``(src_field, id, group_id, n_rows, n_spellings)`` from ``readings``: one row a value that some other reads like.

    The bounded form of ``same_reading_pairs``: a group are all rows with one
    reading, named after its smallest id; groups of one spelling are left out.
    """
    rows = materialize(rows.distinct(), "readings")
    spelled = rows.groupBy("src_field", "key", "value").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    groups = spelled.groupBy("src_field", "key").agg(F.min("least").alias("group_id"), F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings"))
    return rows.join(groups.where("n_spellings > 1"), ["src_field", "key"]).select("src_field", "id", "group_id", "n_rows", "n_spellings").distinct()


def readings(rows: DataFrame, field: str, id_col: str, value_col: str) -> DataFrame:
    """``(src_field, id, key, value)``: digests of how a value reads and what it is.

    Null ids and null values are left out; an empty value is a value.
    """
    text = F.col(value_col)
    return rows.where(F.col(id_col).isNotNull() & text.isNotNull()).select(
        F.lit(field).alias("src_field"),
        F.col(id_col).cast("bigint").alias("id"),
        F.md5(skeleton_column(canonical_column(text))).alias("key"),
        F.md5(text).alias("value"),
    )


def list_readings(rows: DataFrame, field: str, id_col: str, list_col: str) -> DataFrame:
    """The same for a list of strings, compared whole and element by element.

    Each distinct element is brought into its form once; a list is rebuilt from
    its elements in their order.  A null element equals only a null element.
    """
    kept = rows.where(F.col(id_col).isNotNull() & F.col(list_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(list_col).alias("items")
    )
    # elements travel as one text; signs of ASCII, so that the quick check spares what needs no work,
    # and digits, as a letter would mix its script with the element's
    sep = "\x1e"

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: F.coalesce(F.concat(F.lit("1"), F.replace(x, F.lit(sep), F.lit(sep + "x"))), F.lit("0"))), sep + "|")

    one = joined(F.col("items"))
    return kept.select(
        F.lit(field).alias("src_field"),
        "id",
        F.md5(skeleton_column(canonical_column(one))).alias("key"),
        F.md5(one).alias("value"),
    )


def same_reading_pairs(rows: DataFrame) -> DataFrame:
    """``(src_field, id_a, id_b)`` from ``readings``: same key, other value, smaller id first.

    Values are reduced to distinct ones first; pairs are made between the
    values that read the same, few even where a third of all rows has one of
    them, and then expanded to the rows, spread by a salt.
    """
    rows = materialize(rows.distinct(), "readings")
    values = rows.select("src_field", "key", "value").distinct()
    # a reading with very many spellings is spread: each spelling of a part meets all of them
    counted = values.groupBy("src_field", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / SPELLINGS).cast("int")
    values = values.join(counted, ["src_field", "key"]).withColumn("parts", parts)
    left = values.select("src_field", "key", F.col("value").alias("va"), F.pmod(F.xxhash64("value"), "parts").cast("int").alias("part"))
    right = values.select("src_field", "key", F.col("value").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["src_field", "key", "part"]).where("va < vb").select("src_field", "va", "vb")
    several = counted.select("src_field", "key")

    salt = F.array(*(F.lit(i) for i in range(SALTS)))
    owners = rows.join(several, ["src_field", "key"], "left_semi").select("src_field", "value", "id")
    owners = owners.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    a = owners.select("src_field", F.col("value").alias("va"), F.col("id").alias("ia"), "salt")
    b = owners.select("src_field", F.col("value").alias("vb"), F.col("id").alias("ib"), F.col("salt").alias("salt_b"))
    half = pairs.withColumn("salt", F.explode(salt)).join(a, ["src_field", "va", "salt"]).select("src_field", "vb", "ia")
    full = half.withColumn("salt_b", F.explode(salt)).join(b, ["src_field", "vb", "salt_b"])
    # the same id under two values (a row stored twice) is no pair
    return full.where("ia <> ib").select("src_field", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
