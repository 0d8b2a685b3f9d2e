"""Line deduplication on overlapping windows of three lines.

Method: the lines with a word in them are numbered inside their document; every run of ``width``
consecutive ones is hashed (128 bits); windows are counted over all documents; every occurrence but the
first (smallest id, text hash, position) marks its lines, and marked positions are merged and removed.
Windows are judged on the input, not on what is left.

Edge cases: null and empty texts, and documents with fewer than ``width`` such lines, stay as they are; a
null id comes last; rows equal in id and text are one document and get the same result; lines without a
word are never part of a window and stay; an empty table gives an empty table; an input column named
``n_lines`` or ``n_removed`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.keys import KEY, with_key
from docframe.plans.stage import stage

NO_WORD = r"\A[\x20\x09-\x0D]*\z"
SPACES = " \t\n\x0b\x0c\r"


def line_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """``__id, __th, pos, h1, h2``: every window of ``width`` consecutive lines with a word."""
    lines = docs.select(*KEY, F.filter(F.split("__text", "\n", -1), lambda line: ~line.rlike(NO_WORD)).alias("lines"))
    lines = lines.filter(F.size("lines") >= width)
    digests = lines.select(*KEY, F.transform("lines", lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))).alias("h"))

    def window(i: Column) -> Column:
        at = [F.col("h")[i + F.lit(k)] for k in range(width)]
        return F.struct(
            i.alias("pos"), F.xxhash64(*[x["a"] for x in at]).alias("h1"), F.xxhash64(*[x["b"] for x in at]).alias("h2")
        )

    steps = F.sequence(F.lit(0), F.size("h") - width)
    return digests.select(*KEY, F.explode(F.transform(steps, window)).alias("w")).select(*KEY, "w.*")


def repeated_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """``__id, __th, pos``: windows that occur earlier, in their own or another document.

    Counts are combined before the shuffle, so a window that half of all documents share is one row per
    task there; the join back has one row per window on one side and splits where it is skewed.
    """
    windows = stage(line_windows(docs, width), "line-windows")
    place = F.struct(*KEY, "pos")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = firsts.filter(F.col("first") != F.col("last")).select("h1", "h2", "first")
    return windows.join(firsts, ["h1", "h2"]).filter(place > F.col("first")).select(*KEY, "pos")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines`` (with a word) and ``n_removed``."""
    rows = with_key(docs, doc_id, text)
    body = F.coalesce(F.col(text), F.lit(""))
    covered = repeated_windows(rows.select(*KEY, body.alias("__text")), width)
    covered = covered.groupBy(*KEY).agg(F.collect_set("pos").alias("__starts"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([None if at is None else without_lines(t, at, width) for t, at in zip(texts, starts)], dtype=object)

    found = rows.join(covered, KEY, "left")
    touched = F.col("__starts").isNotNull()
    full = F.size(F.filter(F.split(body, "\n", -1), lambda line: ~line.rlike(NO_WORD))).cast("long")
    found = found.withColumn("__new", cut(F.when(touched, F.col(text)), F.col("__starts"))).withColumn("n_lines", full)
    left = F.size(F.filter(F.split("__new", "\n", -1), lambda line: ~line.rlike(NO_WORD))).cast("long")
    return found.withColumns(
        {
            "n_removed": F.when(touched, F.col("n_lines") - left).otherwise(F.lit(0).cast("long")),
            text: F.when(touched, F.col("__new")).otherwise(F.col(text)),
        }
    ).drop(*KEY, "__starts", "__new")


def without_lines(text: str, starts: Iterable[int], width: int) -> str:
    """``text`` without the lines covered by windows; lines with a word are numbered from 0."""
    gone = {i for s in starts for i in range(s, s + width)}
    kept, number = [], 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            number += 1
            if number - 1 in gone:
                continue
        kept.append(line)
    return "\n".join(kept)
