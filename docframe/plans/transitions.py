"""Transition tables of buckets, composed in a tree instead of one long chain.

What a bucket of a sequential packing does to the page that is open at its start depends on that page's fill alone,
so a bucket is a table "fill at the start -> pages started, fill at the end". Two tables in a row are again
such a table. ``entry_states`` composes ``FAN`` neighbours at a time until a key has at most ``FAN`` tables left, walks
these, and hands the states back down level by level. No task reads more than ``FAN`` tables of a key, however
many buckets the key has, and a composed table stays about as long as the longest of its parts once a page
turns inside it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.plans.scan import gathered, whole_groups
from docframe.plans.stage import release, stage

FRESH = -1
"""Fill that says: the next item starts a new page."""
FAN = 64
NEVER = -1
"""``total`` of a bucket that no page passes through unturned."""
BUCKET = "__bucket"
_G = "__group"


def table_fields() -> list[T.StructField]:
    """``fills`` (ascending, then ``FRESH``), ``pages`` and ``ends`` of each, ``total``, ``cap``."""
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("fills", "pages", "ends")]
    return [*lists, T.StructField("total", T.LongType()), T.StructField("cap", T.LongType())]


def as_table(steps: Sequence[tuple[int, int, int]], fresh: tuple[int, int], total: int, cap: int) -> dict:
    """A table from ``(fill, pages, end)`` in ascending order; neighbours with equal results become one."""
    fills: list[int] = []
    pages: list[int] = []
    ends: list[int] = []
    for fill, n, end in steps:
        if fills and (pages[-1], ends[-1]) == (n, end):
            fills[-1] = fill
        else:
            fills.append(fill)
            pages.append(n)
            ends.append(end)
    return {"fills": [*fills, FRESH], "pages": [*pages, fresh[0]], "ends": [*ends, fresh[1]], "total": total, "cap": cap}


def followed(table, fill: int, cap: int) -> tuple[int, int]:
    """Pages that start in a bucket entered with ``fill``, and the fill behind it."""
    at = len(table["fills"]) - 1
    if FRESH < fill <= cap:
        if table["total"] >= 0 and fill + table["total"] <= cap:
            return 0, fill + int(table["total"])
        at = bisect_left(table["fills"], fill, 0, at)
    return int(table["pages"][at]), int(table["ends"][at])


def composed(a, b, cap: int) -> dict:
    """The table of bucket ``a`` and, behind it, bucket ``b``."""
    through = int(a["total"])
    borders = {int(f) for f in a["fills"][:-1]}
    if 0 <= through <= cap:
        borders.add(cap - through)
        borders.update(int(f) - through for f in b["fills"][:-1] if through <= f)
    total = through + int(b["total"]) if through >= 0 and b["total"] >= 0 else NEVER
    total = min(total, cap + 1)

    def both(fill: int) -> tuple[int, int]:
        n, middle = followed(a, fill, cap)
        m, end = followed(b, middle, cap)
        return n + m, end

    steps = [(f, *both(f)) for f in sorted(borders) if total < 0 or f + total > cap]
    return as_table(steps, both(FRESH), total, cap)


_TABLE = ("fills", "pages", "ends", "total", "cap")


def _tables(pdf: pd.DataFrame) -> list[dict]:
    """Tables in row order, as plain lists."""
    plain = ([v.tolist() if hasattr(v, "tolist") else v for v in pdf[c]] for c in _TABLE[:3])
    return [dict(zip(_TABLE, row)) for row in zip(*plain, *(pdf[c].tolist() for c in _TABLE[3:]))]


def _composer(by: list[str], names: list[str]):
    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in whole_groups(batches, by):
            tables, out = _tables(pdf), []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                table = tables[i]
                for later in tables[i + 1 : j]:
                    table = composed(table, later, table["cap"])
                out.append({c: table[c] for c in _TABLE})
            heads = pdf[by].iloc[cuts[:-1]].reset_index(drop=True).rename(columns={_G: BUCKET})
            yield pd.concat([heads, pd.DataFrame(out)], axis=1)[names]

    return compose


def _walker(by: list[str], names: list[str]):
    """Entry states of tables; a group begins with the state in its ``fill`` and ``done``."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in whole_groups(batches, by):
            tables, fills, dones = _tables(pdf), [], []
            entry = list(zip(pdf["fill"].tolist(), pdf["done"].tolist()))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                fill, done = entry[i]
                for table in tables[i:j]:
                    fills.append(fill)
                    dones.append(done)
                    n, fill = followed(table, fill, table["cap"])
                    done += n
            yield pdf.assign(fill=fills, done=dones)[names]

    return walk


def entry_states(tables: DataFrame, keys: Sequence[str], fan: int = FAN) -> DataFrame | None:
    """``keys, __bucket, fill, done`` for every table: fill at its start and pages started before it.

    ``tables``: ``keys, __bucket`` and ``table_fields()``, one row per bucket. They are written once, as is every level
    above; the driver reads two numbers per level. ``None`` without any table.
    """
    keys = list(keys)
    key_fields = [tables.schema[k] for k in keys]
    level_schema = T.StructType([*key_fields, T.StructField(BUCKET, T.LongType()), *table_fields()])
    state_schema = T.StructType([*key_fields, *[T.StructField(c, T.LongType()) for c in (BUCKET, "fill", "done")]])
    group = F.floor(F.col(BUCKET) / F.lit(fan)).cast("long")
    levels = [stage(tables, "transitions")]
    while True:
        low, high = levels[-1].agg(F.min(BUCKET), F.max(BUCKET)).first()
        if low is None:
            release(*levels)
            return None
        if high - low < fan:
            break
        above = gathered(levels[-1].withColumn(_G, group), [*keys, _G], [BUCKET]).mapInPandas(_composer([*keys, _G], level_schema.names), level_schema)
        levels.append(stage(above, "transitions"))

    top = levels[-1].withColumns({"fill": F.lit(FRESH).cast("long"), "done": F.lit(0).cast("long")})
    states = gathered(top, keys, [BUCKET]).mapInPandas(_walker(keys, state_schema.names), state_schema)
    for below in reversed(levels[:-1]):
        # One state per group of at most ``fan`` tables.
        met = below.withColumn(_G, group).join(states.withColumnRenamed(BUCKET, _G), [*keys, _G])
        states = gathered(met, [*keys, _G], [BUCKET]).mapInPandas(_walker([*keys, _G], state_schema.names), state_schema)
    return states
