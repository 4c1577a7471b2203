"""Column functions shared by operators and queries."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column | str) -> Column:
    """Array of maximal ASCII letter runs, lower-cased after extraction.

    Extracting first keeps letters whose lower case is ASCII (the Kelvin sign) out.
    """
    return F.transform(letter_runs(text), F.lower)


def letter_runs(text: Column | str) -> Column:
    """Array of maximal ASCII letter runs as they are; lower-casing after an explode stays inside compiled code."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))


def int32_wrap(total: Column) -> Column:
    """A 64-bit sum reduced to the value a wrapping signed 32-bit sum would have."""
    bias = F.lit(1 << 31).cast("bigint")
    return ((total.cast("bigint") + bias).bitwiseAND(F.lit((1 << 32) - 1)) - bias).cast("int")
