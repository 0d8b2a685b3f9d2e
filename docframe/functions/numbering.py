"""Counter text: roman, alphabetic and decorated numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.functions.js import let

# Roman digits by decimal place.
_ONES = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
_TENS = ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]
_HUNDREDS = ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]


def _digit(table: list[str], n: Column, unit: int) -> Column:
    place = F.floor(n / F.lit(unit)).cast("int") % 10
    return F.element_at(F.array(*[F.lit(s) for s in table]), place + 1)


def roman(n: Column) -> Column:
    """Lower-case roman number; empty for values below 1."""
    return F.when(
        n > 0,
        F.concat(
            F.repeat(F.lit("m"), F.floor(n / F.lit(1000)).cast("int")),
            _digit(_HUNDREDS, n, 100),
            _digit(_TENS, n, 10),
            _digit(_ONES, n, 1),
        ),
    ).otherwise("")


def alpha(n: Column) -> Column:
    """Lower-case spreadsheet-style letters (1 = a, 27 = aa); empty for values below 1."""
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        low = acc["left"] - 1
        letter = F.char((F.lit(97) + low % 26).cast("long"))
        return F.when(
            acc["left"] > 0,
            F.struct(
                F.floor(low / F.lit(26)).cast("long").alias("left"),
                F.concat(letter, acc["out"]).alias("out"),
            ),
        ).otherwise(acc)

    # 14 letters cover every 64-bit value.
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["out"])


def auto_number(kind: Column, n: Column) -> Column:
    """Text of an automatically numbered bullet such as ``arabicPeriod`` or ``alphaUcParenBoth``."""
    plain = (
        F.when(kind.startswith("alpha"), alpha(n)).when(kind.startswith("roman"), roman(n)).otherwise(n.cast("string"))
    )
    upper = kind.startswith("alphaUc") | kind.startswith("romanUc")
    core = let(plain, lambda p: F.when(upper, F.upper(p)).otherwise(p))
    return let(
        core,
        lambda c: F.when(kind.endswith("ParenBoth"), F.concat(F.lit("("), c, F.lit(")")))
        .when(kind.endswith("ParenR"), F.concat(c, F.lit(")")))
        .when(kind.endswith("Plain"), c)
        .when(kind.endswith("Minus"), F.concat(F.lit("- "), c, F.lit(" -")))
        .otherwise(F.concat(c, F.lit("."))),
    )


def counter_text(n: Column, style: Column) -> Column:
    """Text of a list counter in a named style (``lower-roman``, ``upper-alpha``, ...)."""
    text = n.cast("string")
    rom = F.when((n <= 0) | (n >= 4000), text).otherwise(roman(n))
    alp = F.when(n <= 0, text).otherwise(alpha(n))
    return (
        F.when(style == "lower-roman", rom)
        .when(style == "upper-roman", F.upper(rom))
        .when(style.isin("lower-alpha", "lower-latin"), alp)
        .when(style.isin("upper-alpha", "upper-latin"), F.upper(alp))
        .when(style == "decimal-leading-zero", F.when((n >= 0) & (n < 10), F.concat(F.lit("0"), text)).otherwise(text))
        .when(style == "none", F.lit(""))
        .when(style == "disc", F.lit("•"))
        .otherwise(text)
    )
