"""Date parsing and day arithmetic, all in ``timestamp_ntz`` / ``date``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the text shapes of ``fecha`` that every source may use (ISO date,
# optionally a time with or without seconds and fraction, space or 'T' separated, and
# a zone, whose wall-clock time is kept). Other shapes are named per source.
DATE_TEXT_PATTERN = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_ZONE = r"(?<=\d{2}:\d{2}.{0,10})(Z|[+-]\d{2}:?\d{2})$"


def parse_fecha(c: Column, dtype: T.DataType, formats: tuple[str, ...] = ()) -> Column:
    """``fecha`` as ``timestamp_ntz``; anything unreadable becomes NULL.

    Text is checked against :data:`DATE_TEXT_PATTERN` and then ``try_cast``,
    so impossible dates (2025-02-30) are NULL as well; what that does not read is
    tried with the source's own ``formats`` (datetime patterns such as
    ``dd/MM/yyyy``), in order. Never raises.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    text = F.trim(c.cast("string"))
    # Few texts have a zone, and looking for one costs more than all the rest: only those with a sign of it after the date.
    after = F.substring(text, 11, 40)
    zoned = after.contains("Z") | after.contains("+") | after.contains("-")
    plain = F.when(zoned, F.regexp_replace(text, _ZONE, "")).otherwise(text)
    iso = F.when(text.rlike(DATE_TEXT_PATTERN), plain.try_cast("timestamp_ntz"))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def as_date(value: str | dt.date | None) -> dt.date | None:
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])


def day(c: Column) -> Column:
    """Calendar day of a timestamp (rules compare days, not instants)."""
    return F.to_date(c)
