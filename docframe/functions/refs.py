"""Cell references and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.functions.js import let, trim

# Grid bounds of a sheet.
MAX_COL, MAX_ROW = 16_384, 1_048_576

_CELL = r"(?i)^\$?([A-Z]{1,3})\$?(\d+)$"
_ROWS = r"^\$?(\d+):\$?(\d+)$"
_COLS = r"(?i)^\$?([A-Z]{1,3}):\$?([A-Z]{1,3})$"


def col_index(letters: Column) -> Column:
    """Column number of spreadsheet letters (A = 1, AA = 27)."""
    chars = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: acc * 26 + (F.ascii(c) - 64).cast("long"))


def parse_ref(ref: Column) -> Column:
    """``struct(row, col)`` of ``$B$3``, or null."""
    ref = trim(ref)
    return F.when(
        ref.rlike(_CELL),
        F.struct(
            F.regexp_extract(ref, _CELL, 2).cast("long").alias("row"), col_index(F.regexp_extract(ref, _CELL, 1)).alias("col")
        ),
    )


def parse_range(text: Column) -> Column:
    """``struct(r1, c1, r2, c2)`` of a cell, a range, whole rows or whole columns, or null."""
    clean = trim(F.replace(F.regexp_replace(text, r"^.*!", ""), F.lit("'"), F.lit("")))

    def build(c: Column) -> Column:
        head = F.split_part(c, F.lit(":"), F.lit(1))
        tail = F.split_part(c, F.lit(":"), F.lit(2))

        def box(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
            return F.struct(
                r1.cast("long").alias("r1"), c1.cast("long").alias("c1"), r2.cast("long").alias("r2"), c2.cast("long").alias("c2")
            )

        # Each end is parsed once: a column used twice inside a lambda is computed twice.
        def cells(start: Column) -> Column:
            return let(
                F.when(tail == "", start).otherwise(parse_ref(tail)),
                lambda end: F.when(
                    start.isNotNull() & end.isNotNull(),
                    box(
                        F.least(start["row"], end["row"]), F.least(start["col"], end["col"]),
                        F.greatest(start["row"], end["row"]), F.greatest(start["col"], end["col"]),
                    ),
                ),
            )

        rows = box(F.regexp_extract(c, _ROWS, 1).try_cast("long"), F.lit(1), F.regexp_extract(c, _ROWS, 2).try_cast("long"), F.lit(MAX_COL))
        cols = box(F.lit(1), col_index(F.regexp_extract(c, _COLS, 1)), F.lit(MAX_ROW), col_index(F.regexp_extract(c, _COLS, 2)))
        whole = F.when(c.rlike(_ROWS), rows).when(c.rlike(_COLS), cols)
        return F.coalesce(let(parse_ref(head), cells), whole)

    return let(clean, build)


def split_areas(formula: Column) -> Column:
    """Split an area list on the commas outside single quotes; an empty last part is dropped."""
    # Every piece is "one comma or the start, then quoted or plain text".
    pieces = F.regexp_extract_all(F.concat(F.lit(","), formula), F.lit(r",(?:'[^']*'|[^,'])*"), F.lit(0))
    parts = F.transform(pieces, lambda p: F.substring(p, 2, 2_147_483_647))
    return let(
        parts,
        lambda a: F.when(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("x")) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a),
    )
