"""Row keys, column names and the check against Spark settings shared by the operators.

Ids may be null or repeat. A row is known by ``(id, hash of its text)``: rows equal in both are copies
of one document and get the same result. A null id sorts after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = (1 << 63) - 1
KEY = ["__id", "__th"]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``__id, __th, __text`` of every row; a null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(id_of(doc_id), F.xxhash64(body).alias("__th"), body.alias("__text"))


def id_of(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("__id")


def with_key(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All columns of ``docs`` and the row key."""
    return docs.withColumn("__id", id_of(doc_id)).withColumn("__th", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def id_back(name: str = "doc_id", column: str = "__id") -> Column:
    """The id again, null where it was null."""
    return F.when(F.col(column) != F.lit(LAST), F.col(column)).alias(name)
