"""Numeric helpers: strict-but-safe typing, exact money sums, the two roundings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def to_number(c: Column, dtype: T.DataType) -> Column:
    """A number column as double; text that is not a number and NaN -> NULL."""
    if isinstance(dtype, T.StringType):
        x = F.trim(c).try_cast("double")
    else:
        x = c.cast("double")
    return F.when(~F.isnan(x), x)


def unreadable_number(c: Column, dtype: T.DataType) -> Column:
    """True where a text cell holds something that is not a number."""
    if not isinstance(dtype, T.StringType):
        return F.lit(False)
    text = F.trim(c)
    return (text.isNotNull() & (text != "") & text.try_cast("double").isNull())


def money(c: Column) -> Column:
    """Amount as ``decimal(18,2)``: sums are exact and independent of the
    partitioning, so every run and every engine adds to the same cent. An
    amount beyond that range (a typo like 1e300) is NULL and adds nothing; the
    incident report counts it."""
    return c.try_cast(MONEY)


def beyond_money(c: Column) -> Column:
    """True for an amount that no ``decimal(18,2)`` holds."""
    return c.isNotNull() & money(c).isNull()


def money_sum(c: Column) -> Column:
    """Sum of amounts in cents, 0 for an empty or all-null set."""
    return F.coalesce(F.sum(money(c)), F.lit(0).cast(MONEY))


def whole_even(c: Column) -> Column:
    """Whole units, half to even (the per-row metrics' rounding)."""
    return F.bround(c, 0).cast("bigint")


def whole_up(c: Column) -> Column:
    """Whole units, half away from zero (the SQL dashboard's rounding)."""
    return F.round(c, 0).cast("bigint")


def python_float_text(c: Column) -> Column:
    """A double as Python's ``repr`` prints it (the raw landing's text form):
    plain digits for 1e-4 <= |x| < 1e16, else ``1.5e+16`` / ``1e-05``.

    Spark prints the same shortest digits but switches to exponent notation
    outside [1e-3, 1e7): inside Python's plain range those are expanded by an
    exact decimal cast, outside it the exponent is reformatted. (On Java 17,
    ``Double.toString`` is not always the shortest form for some values above
    1e16, whose last digits can then differ from Python's.)
    """
    x = c.cast("double")
    s = x.cast("string")
    # The handful of numbers with an exponent take a function of their own: written out for every column and row,
    # their code makes the whole job's too long for the JVM to compile.
    return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
             .when(~s.contains("E"), s)
             .otherwise(F.element_at(F.transform(F.array(x), _exponent_text), 1)))


def _exponent_text(x: Column) -> Column:
    """:func:`python_float_text` of a double that Spark prints with an exponent."""
    s = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"),
                                              "0+$", ""), r"\.$", ".0")
    sci = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        s, r"\.0E", "E"), r"E-(\d)$", "e-0$1"), "E-", "e-"), "E", "e+")
    ax = F.abs(x)
    return (F.when((ax >= F.lit(1e16)) | (ax < F.lit(1e-4)), sci)
             .otherwise(plain))
