"""Packing of paragraphs, headings and tables with keep-together rules, split across tasks inside one section.

A page is a function of the place where it starts: the same start gives the same page and the same next start.
So a section is cut into buckets of blocks; each bucket is reduced to a transition table "fill of the page that is
open at its first block -> pages started, fill and state at its end", the tables are composed in a tree
(:mod:`docframe.plans.transitions`), and every bucket is then placed on its own. A bucket never begins right after a heading, since headings
may still move to the next page with what follows them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.plans.packing import SLACK, UNITS
from docframe.plans.scan import bucket_of, gathered, ordered_scan, whole_groups
from docframe.plans.stage import stage
from docframe.plans.transitions import FRESH, as_table, entry_states, table_fields

BUCKET_BLOCKS = 16_384
LEAST_ROOM = 12
"""A table row is divided only where this much of the page is left at its top."""
_SLACK, _ROOM = round(SLACK * UNITS), LEAST_ROOM * UNITS
_B = "__bucket"
_COLUMNS = ("ord", "kind", "units", "height", "header", "lines", "whole")

Block = tuple[int, str, int, int, int, int, bool]
Start = tuple[int, int, int, int]
"""Block, first unit, first line of it, header rows repeated above."""


class Page:
    """What one page holds: its parts, the start of the next page (if one follows), and its state at the end."""

    def __init__(self, parts: list[tuple], following: Start | None, fill: int):
        self.parts, self.following, self.fill = parts, following, fill


def _divided(block: Block, start: Start, room: int, first: bool) -> tuple[int, int, Start] | None:
    """Last unit, last line of what stays of a block that does not fit, and where the rest starts."""
    _, kind, units, height, header, lines, whole = block
    i, unit, line, repeated = start
    if kind in ("para", "heading"):
        fits = room // height
        return (unit + fits - 1, lines, (i, unit + fits, 1, 0)) if fits >= (1 if first else 2) else None
    if kind != "table":
        return None
    held = header if (unit, line) == (1, 1) else repeated
    rest = height - (line - 1) * height // lines  # of the first row
    if room // height < repeated:
        over, top = room // height, room // height * height
    elif repeated * height + rest > room:
        over, top = repeated, repeated * height
    else:
        more = (room - repeated * height - rest) // height
        over, top = repeated + 1 + more, repeated * height + rest + more * height
    if not whole and lines > 1 and over >= max(held, repeated) and room - top - _SLACK >= _ROOM:
        row, from_line = unit + over - repeated, line if over == repeated else 1
        done = (from_line - 1) * height // lines
        last = ((room - top + done + 1) * lines - 1) // height
        if last >= from_line:
            return row, last, (i, row, last + 1, header)
    if over <= held:
        over = max(held + 1, 1)
        if not first or over >= repeated + units - unit + 1:
            return None
    last = unit + over - 1 - repeated
    return last, lines, (i, last + 1, 1, header)


def lay_page(blocks: list[Block], limit: int, start: Start, fill: int = FRESH) -> Page:
    """The page that starts at ``start``, or goes on there with ``fill`` used by blocks before ``blocks``."""
    first_block = start[0] if fill == FRESH else -1
    i, unit, line, repeated = start
    count, fill = (0, 0) if fill == FRESH else (1, fill)
    parts: list[tuple] = []
    while i < len(blocks):
        ord_, kind, units, height, _, lines, _ = blocks[i]
        size = (repeated + units - unit + 1) * height - (line - 1) * height // lines
        if size <= 0 or fill + size <= limit:
            parts.append((ord_, unit, units, repeated, line, lines))
            fill, count = fill + size, count + 1
            i, unit, line, repeated = i + 1, 1, 1, 0
            continue
        cut = _divided(blocks[i], (i, unit, line, repeated), limit - fill, count == 0)
        if cut is not None:
            parts.append((ord_, unit, cut[0], repeated, line, cut[1]))
            return Page(parts, cut[2], fill)
        if count == 0:
            # Taller than a page and not divisible: it stays here, the next block turns the page.
            parts.append((ord_, unit, units, repeated, line, lines))
            return Page(parts, (i + 1, 1, 1, 0), FRESH)
        j = i
        while j - 1 > first_block and blocks[j - 1][1] == "heading":
            j -= 1
        return Page(parts[: len(parts) - (i - j)], (j, 1, 1, 0), fill)
    return Page(parts, None, fill)


def _ends(blocks: list[Block], limit: int, start: Start, known: dict[Start, tuple[int, int]]) -> tuple[int, int]:
    """Pages started from ``start`` on, and the fill at the end of the bucket (``FRESH``: the next block turns)."""
    path, at = [], start
    while at not in known:
        if at[0] >= len(blocks):
            known[at] = (0, FRESH)
            break
        page = lay_page(blocks, limit, at)
        if page.following is None:
            known[at] = (1, page.fill)
            break
        path.append(at)
        at = page.following
    for n, earlier in enumerate(reversed(path), 1):
        known[earlier] = (known[at][0] + n, known[at][1])
    return known[start]


def transitions(blocks: list[Block], limit: int) -> dict:
    """The bucket as a table: for an open page filled up to ``fills[k]``, ``pages[k]`` pages start and ``ends[k]`` is filled.

    The last entry stands for a page that turns before the first block; ``total`` is added where no page turns.
    """
    known: dict[Start, tuple[int, int]] = {}
    borders, top = {limit}, 0
    for _, kind, units, height, _, lines, _ in blocks:
        left = limit - top
        if left < 0:
            break
        borders.add(left)
        if height > 0:
            n = min(units, left // height)
            for k in range(n + 1):
                borders.add(left - k * height)
                if kind == "table" and lines > 1:
                    borders.update(left - k * height - e * height // lines for e in range(1, lines))
                    borders.add(left - k * height - _SLACK - _ROOM)
        top += units * height
    total = sum(b[2] * b[3] for b in blocks)
    steps = []
    for fill in sorted(b for b in borders if 0 <= b <= limit):
        if fill + total <= limit:
            continue
        page = lay_page(blocks, limit, (0, 1, 1, 0), fill)
        steps.append((fill, 0, page.fill) if page.following is None else (fill, *_ends(blocks, limit, page.following, known)))
    return as_table(steps, _ends(blocks, limit, (0, 1, 1, 0), known), total, limit)


def _bucketed(blocks: DataFrame, keys: list[str], bucket_blocks: int) -> DataFrame:
    """``blocks`` with a bucket that never begins behind a heading."""
    raw = bucket_of("ord", bucket_blocks)
    seen = ordered_scan(blocks, keys, ["ord"], raw, lag={"__before": F.col("kind")}).withColumn("__raw", raw)
    begins = F.min(F.when(F.col("__before").isNull() | (F.col("__before") != "heading"), F.col("ord")))
    heads = seen.groupBy(*keys, "__raw").agg(begins.alias("__from"))
    earlier = Window.partitionBy(*keys).orderBy("__raw").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("__last", F.last(F.when(F.col("__from").isNotNull(), F.col("__raw")), ignorenulls=True).over(earlier))
    placed = seen.join(heads, [*keys, "__raw"]).withColumn(_B, F.when(F.col("ord") >= F.col("__from"), F.col("__raw")).otherwise(F.col("__last")))
    return placed.drop("__raw", "__before", "__from", "__last")


def pack_blocks(blocks: DataFrame, capacity: float, bucket_blocks: int = BUCKET_BLOCKS) -> DataFrame:
    """Pages per section: ``doc_id, section, ord, page_no, first_unit, last_unit, repeated_rows, first_line, last_line``.

    ``blocks``: ``doc_id, section, ord, kind (heading/para/table/other), units, unit_height, header_rows`` and
    optionally ``row_lines`` (lines of every table row, 1 if missing) and ``cant_split`` (rows stay whole). A
    paragraph breaks between lines, with at least two lines left on a page it does not start; a table breaks
    between rows and repeats its header rows; the row at the page end is divided between its lines unless it
    is a header, can't be split, or less than ``LEAST_ROOM`` is left at its top; headings move with the
    block that follows them; anything else stays whole. A section starts on a new page. No task holds a section
    or all its tables. A run of headings is not cut into buckets.
    """
    keys, limit = ["doc_id", "section"], round((capacity + SLACK) * UNITS)
    optional = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in blocks.columns else F.lit(default)
    base = blocks.select(
        *keys, F.col("ord").cast("long").alias("ord"), "kind", F.col("units").cast("long").alias("units"),
        F.round(F.col("unit_height").cast("double") * UNITS).cast("long").alias("height"), F.col("header_rows").cast("long").alias("header"),
        F.greatest(optional("row_lines", 1).cast("long"), F.lit(1)).alias("lines"), optional("cant_split", False).alias("whole"),
    )
    # Read for the count of buckets, the tables and the placement: the text behind the blocks is cut once.
    rows = stage(_bucketed(base, keys, bucket_blocks), "blocks")
    key_fields = [base.schema[k] for k in keys]
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]

    def listed(pdf: pd.DataFrame) -> list[Block]:
        return list(zip(*(pdf[c].tolist() for c in _COLUMNS)))

    # Sections of one bucket start with it and need no table.
    several = rows.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    several = several.filter("of > 1").select(*keys, _B)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in whole_groups(batches, [*keys, _B]):
            all_ = listed(pdf)
            tables = pd.DataFrame([transitions(all_[i:j], limit) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
            yield pd.concat([pdf[[*keys, _B]].iloc[cuts[:-1]].reset_index(drop=True), tables], axis=1)

    schema = T.StructType([*key_fields, *longs(_B), *table_fields()])
    ordered = gathered(rows.join(several, [*keys, _B], "left_semi"), [*keys, _B], ["ord"])
    tables = ordered.mapInPandas(reduced, schema)

    entries = entry_states(tables, keys)

    def laid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in whole_groups(batches, [*keys, _B]):
            out: list[tuple] = []
            all_, before = listed(pdf), pdf["done"].tolist()
            heads = list(zip(*(pdf[k].iloc[cuts[:-1]].tolist() for k in keys)))
            for key, i, j in zip(heads, cuts[:-1].tolist(), cuts[1:].tolist()):
                fill, done = FRESH, 0
                if before[i] >= 0:  # the entry state
                    fill, done, i = all_[i][2], before[i], i + 1
                some, at = all_[i:j], (0, 1, 1, 0)
                while at is not None and at[0] < len(some):
                    page = lay_page(some, limit, at, fill)
                    done += fill == FRESH
                    out += [(*key, p[0], done, *p[1:]) for p in page.parts]
                    at, fill = page.following, FRESH
            yield pd.DataFrame(out, columns=result.names)

    result = T.StructType([*key_fields, *longs("ord", "page_no", "first_unit", "last_unit", "repeated_rows", "first_line", "last_line")])
    marked = rows.withColumn("done", F.lit(-1).cast("long")).withColumn("__first", F.lit(1))
    if entries is not None:
        states = entries.select(
            *keys, F.lit(-1).cast("long").alias("ord"), F.lit("").alias("kind"), F.col("fill").alias("units"), *[F.lit(0).cast("long").alias(c) for c in ("height", "header", "lines")],
            F.lit(False).alias("whole"), _B, "done", F.lit(0).alias("__first"),
        )
        marked = marked.unionByName(states)
    return gathered(marked, [*keys, _B], ["__first", "ord"]).mapInPandas(laid, result)


def blocks_sql(blocks: str, capacity: float) -> str:
    """The same as one walk per section, a block or a page turn per step (``blocks``: a query with all columns)."""
    return f"""
SELECT * FROM (WITH RECURSIVE b AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY ord) AS i FROM ({blocks})),
walk AS (
  SELECT doc_id, section, 1::BIGINT AS i, 1::BIGINT AS s, 1::BIGINT AS l, 0::BIGINT AS r, 0::DOUBLE AS fill, 0::BIGINT AS c, 0::BIGINT AS h, 1::BIGINT AS page,
         NULL::BIGINT AS p_ord, NULL::BIGINT AS p_page, NULL::BIGINT AS p_first, NULL::BIGINT AS p_last, NULL::BIGINT AS p_rep, NULL::BIGINT AS p_fl, NULL::BIGINT AS p_ll
  FROM (SELECT DISTINCT doc_id, section FROM b)
  UNION ALL
  SELECT doc_id, section,
         CASE WHEN fits THEN i + 1 WHEN part OR cut > 0 THEN i WHEN c = 0 THEN i + 1 ELSE i - h END,
         CASE WHEN fits THEN 1 WHEN part THEN s + si - r WHEN cut > 0 THEN s + cut - r ELSE 1 END,
         CASE WHEN NOT fits AND part THEN e + 1 ELSE 1 END,
         CASE WHEN NOT fits AND (part OR cut > 0) AND kind = 'table' THEN header_rows ELSE 0 END,
         CASE WHEN fits THEN fill + size ELSE 0 END,
         CASE WHEN fits THEN c + 1 ELSE 0 END,
         CASE WHEN fits AND kind = 'heading' AND c > 0 THEN h + 1 ELSE 0 END,
         CASE WHEN fits THEN page ELSE page + 1 END,
         CASE WHEN fits OR part OR cut > 0 OR c = 0 THEN ord END, page, s,
         CASE WHEN fits THEN units WHEN part THEN s + si - r WHEN cut > 0 THEN s + cut - r - 1 ELSE units END, r, l,
         CASE WHEN NOT fits AND part THEN e ELSE row_lines END
  FROM (SELECT *, kind = 'table' AND NOT cant_split AND row_lines > 1 AND si >= greatest(held, r) AND room - top - {SLACK} >= {LEAST_ROOM} AND e >= fl AS part,
               CASE WHEN kind IN ('para', 'heading') THEN CASE WHEN f >= (CASE WHEN c = 0 THEN 1 ELSE 2 END) THEN f ELSE 0 END
                    WHEN kind <> 'table' THEN 0 WHEN si > held THEN si WHEN c > 0 OR greatest(held + 1, 1) >= r + units - s + 1 THEN 0 ELSE greatest(held + 1, 1) END AS cut
        FROM (SELECT *, fl - 1 + floor((room - top) / (unit_height / row_lines))::BIGINT AS e
              FROM (SELECT *, CASE WHEN si <= r THEN si * unit_height ELSE r * unit_height + rest + (si - r - 1) * unit_height END AS top, CASE WHEN si = r THEN l ELSE 1 END AS fl
                    FROM (SELECT *, CASE WHEN f < r THEN f WHEN rest > room - r * unit_height THEN r ELSE r + 1 + floor((room - r * unit_height - rest) / unit_height)::BIGINT END AS si,
                                 size <= 0 OR fill + size <= {capacity + SLACK} AS fits
                          FROM (SELECT w.* EXCLUDE (p_ord, p_page, p_first, p_last, p_rep, p_fl, p_ll), b.ord, b.kind, b.units, b.unit_height, b.header_rows, b.row_lines, b.cant_split,
                                       (r + units - s + 1) * unit_height - (l - 1) * unit_height / row_lines AS size, {capacity + SLACK} - fill AS room,
                                       floor(({capacity + SLACK} - fill) / unit_height)::BIGINT AS f, unit_height - (l - 1) * unit_height / row_lines AS rest,
                                       CASE WHEN s = 1 AND l = 1 THEN header_rows ELSE r END AS held
                                FROM walk w JOIN b USING (doc_id, section, i))))))
)
SELECT doc_id, section, p_ord AS ord, max(p_page) AS page_no, p_first AS first_unit, last(p_last ORDER BY p_page) AS last_unit, last(p_rep ORDER BY p_page) AS repeated_rows,
       p_fl AS first_line, last(p_ll ORDER BY p_page) AS last_line
FROM walk WHERE p_ord IS NOT NULL GROUP BY doc_id, section, p_ord, p_first, p_fl)"""
