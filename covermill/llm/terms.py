"""Problem 1: frequency of every distinct value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.functions.scalar import BLANK, compared


def term_frequencies(df: DataFrame, record: str, value: str, unit: str) -> DataFrame:
    """``value, occurrences, records`` of every distinct value in compared form.

    A value occurs once per ``(record, unit)`` however often the row is repeated. Three aggregations, each combined
    by hash before its shuffle and each on its whole key, so neither a hot value nor a hot record fills one task:
    distinct occurrences, occurrences per record and value, sums per value. Null and blank values and null records
    do not count; a null unit is a unit. An empty table gives no rows.
    """
    rows = df.select(F.col(record).alias("record"), compared(F.col(value)).alias("value"), F.col(unit).alias("unit"))
    distinct = rows.where("record is not null and value <> ''").dropDuplicates(["value", "record", "unit"])
    per_record = distinct.groupBy("value", "record").agg(F.count("*").alias("times"))
    return per_record.groupBy("value").agg(F.sum("times").alias("occurrences"), F.count("*").alias("records"))


def records_with_values(df: DataFrame, record: str, value: str) -> int:
    """How many records have a value that counts."""
    seen = df.where(F.col(record).isNotNull() & F.col(value).rlike(BLANK.replace("[", "[^", 1)))
    return seen.select(record).distinct().count()


def marked_terms(df: DataFrame, record: str, value: str, unit: str, rare_most: int, common_share: float) -> DataFrame:
    """``term_frequencies`` with ``freq_mark``: ``rare`` in at most ``rare_most`` records, ``common`` in more than
    ``common_share`` of the records that have a value, else null. Rare goes first where both hold."""
    total = records_with_values(df, record, value)
    mark = F.when(F.col("records") <= rare_most, "rare").when(F.col("records") > common_share * total, "common")
    return term_frequencies(df, record, value, unit).withColumn("freq_mark", mark)
