"""Text and number rules that follow JavaScript rather than Java semantics."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters JavaScript treats as whitespace.
WS = r"[\t\n\u000B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NOT_WS = WS.replace("[", "[^", 1)
# A run to collapse; single plain spaces stay untouched, which spares one replacement per word.
_RUN = WS + "{2,}|" + WS.replace("\\r ", "\\r", 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def _nfkd(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


def nfc(c: Column | str) -> Column:
    """Canonical composition. Python gets nulls for rows without a character from U+0300 up."""
    c = _col(c)
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\u0000-\u02FF]"), c)), c)


def nfkd(c: Column | str) -> Column:
    """Compatibility decomposition. Python gets nulls for ASCII rows."""
    c = _col(c)
    return F.coalesce(_nfkd(F.when(c.rlike(r"[^\u0000-\u007F]"), c)), c)


def collapse(c: Column | str) -> Column:
    """Runs of whitespace become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), _RUN, " "))


def trim(c: Column | str) -> Column:
    """Strip whitespace at both ends."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def js_round(c: Column | str) -> Column:
    """Half-up rounding towards positive infinity."""
    return F.floor(_col(c) + F.lit(0.5))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_or_empty(items: Column) -> Column:
    """First element of an array, or an empty string."""
    return F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))


def extension(name: Column | str) -> Column:
    """Lower-cased extension with its dot, or an empty string."""
    return F.regexp_extract(F.lower(_col(name)), r"\.[^.]+$", 0)


def stem(name: Column | str) -> Column:
    """Name without its last extension."""
    return F.regexp_replace(_col(name), r"\.[^.]+$", "")
