"""Column-level helpers (all JVM-side except the customer key UDF)."""

from ordergate.functions.dates import as_date, day, parse_fecha
from ordergate.functions.numbers import (beyond_money, money, money_sum, to_number,
                                         unreadable_number, whole_even, whole_up)
from ordergate.functions.text import contains_ci, customer_key, customer_key_py, utrim

__all__ = [
    "as_date", "day", "parse_fecha", "beyond_money", "money", "money_sum", "to_number",
    "unreadable_number", "whole_even", "whole_up", "contains_ci", "customer_key",
    "customer_key_py", "utrim",
]
