"""Column functions of the sensor operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_header(name: str) -> str:
    """A header as a lower-case identifier: the degree sign reads deg, runs of anything else an underscore."""
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower().replace("°", "deg")).strip("_")


def normalized_header(column: str | Column) -> Column:
    """``normalize_header`` over a column."""
    c = F.col(column) if isinstance(column, str) else column
    c = F.replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit("°"), F.lit("deg"))
    return F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def number(column: str | Column) -> Column:
    """Text or number as a double; what does not convert, and NaN, is null."""
    c = F.col(column) if isinstance(column, str) else column
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


#: Date formats tried after the ISO forms that a cast reads.
DATE_FORMATS = ("yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "yyyy/MM/dd", "dd.MM.yyyy HH:mm:ss")


def instant(column: str | Column) -> Column:
    """Text as a timestamp, null where no format fits."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.try_cast("timestamp"), *[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def clip(column: Column, limit: float) -> Column:
    """Between -|limit| and |limit|."""
    return F.least(F.greatest(column, F.lit(-abs(limit))), F.lit(abs(limit)))
