"""Text helpers: Unicode trim, the customer key, literal case-insensitive search."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The customer-key UDF below runs on executors. Ship this module's code with
# the task (by value) so workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the characters Python's str.strip()/str.split() treat as
# whitespace. Java's (?U)\s covers all of them except the four ASCII
# separators \x1c-\x1f, which are added explicitly.
_WS = r"[\s\x1c-\x1f]"
_TRIM_PATTERN = rf"(?U)^{_WS}+|{_WS}+$"


def utrim(c: Column) -> Column:
    """Trim like Python ``str.strip()`` (Spark ``trim`` removes spaces only)."""
    return F.regexp_replace(c, _TRIM_PATTERN, "")


class _KeyLetters(dict):
    """What each code point of a decomposed spelling becomes in a key: capitals for ASCII letters,
    one blank for ASCII white space, nothing for dots and for whatever is not ASCII."""

    def __missing__(self, code: int) -> str:
        letter = chr(code)
        out = "" if code > 127 or letter == "." else " " if letter.isspace() else letter.upper()
        self[code] = out
        return out


_KEY_LETTERS = _KeyLetters()
_BLANKS = re.compile(" {2,}")


def customer_key_py(value: str | None) -> str | None:
    """The key of one spelling: accents, dots and signs beyond ASCII don't count, nor do case and
    the amount of white space."""
    if value is None:
        return None
    return _BLANKS.sub(" ", unicodedata.normalize("NFKD", value).translate(_KEY_LETTERS)).strip(" ")


@F.pandas_udf(T.StringType())
def _customer_key_udf(spellings: pd.Series) -> pd.Series:
    return spellings.map(customer_key_py, na_action="ignore")


def customer_key(c: Column) -> Column:
    """Customer key of a spelling column.

    Spark has no Unicode normaliser, so this is an Arrow-batched pandas UDF.
    Call it on *distinct* spellings only (the gate does), never per order line.
    """
    return _customer_key_udf(c)


def contains_ci(c: Column, needle_lower: str) -> Column:
    """Literal, case-insensitive substring test; a null cell never matches."""
    return F.coalesce(F.contains(F.lower(c), F.lit(needle_lower)), F.lit(False))
