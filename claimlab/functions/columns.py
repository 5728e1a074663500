"""Column expressions for typing, features and binning. All stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlab.functions.labels import CPI_FACTORS, CPI_FIRST_YEAR


# The characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# A cast also reads hexadecimal numbers, type suffixes, NaN and Infinity, and skips control characters at the ends.
_NOT_IN_NUMBERS = "dDfFxXnNiIpP" + "".join(map(chr, range(32)))


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def number(text: Column) -> Column:
    """Text to double; anything that is not a plain decimal number becomes null."""
    plain = stripped(text)
    return F.when(F.translate(plain, _NOT_IN_NUMBERS, "") == plain, plain.try_cast("double"))


def currency(text: Column) -> Column:
    """Dollar text such as `$1,234` to double; blank and unreadable text become null."""
    return number(F.translate(text, "$,", ""))


def coded_integer(value: Column, is_text: bool, target: str = "int") -> Column:
    """Coded number to a nullable integer, rounding half to even."""
    return F.rint(number(value) if is_text else value.cast("double")).try_cast(target)


def code_string(text: Column) -> Column:
    """Trimmed upper-case code; blank, NAN and NONE become null."""
    code = F.upper(stripped(text.cast("string")))
    return F.when(code.isin("", "NAN", "NONE"), F.lit(None)).otherwise(code)


def country_string(text: Column) -> Column:
    """Deprecated country column as text, with the text `nan` read as missing."""
    return F.nullif(text.cast("string"), F.lit("nan"))


def floor_to(value: Column, width: int) -> Column:
    """Largest multiple of `width` not above `value`."""
    return (F.floor(value / F.lit(width)) * width).cast("int")


def period_label(year: Column, width: int) -> Column:
    """`1990-1999` style label of the period that holds a year; null stays null."""
    start = floor_to(year, width)
    return F.concat(start.cast("string"), F.lit("-"), (start + (width - 1)).cast("string"))


def cpi_factor(year: Column, factors: list[float] | None = None, first_year: int = CPI_FIRST_YEAR) -> Column:
    """Inflation factor of a year by position in a constant array; null outside the table."""
    table = ", ".join(f"{float(factor)!r}D" for factor in (factors or CPI_FACTORS))
    return F.get(F.expr(f"array({table})"), year - F.lit(first_year))


def positive_log(amount: Column, base10: bool = False) -> Column:
    """Logarithm of a positive amount, otherwise null."""
    return F.when(amount > 0, F.log10(amount) if base10 else F.ln(amount))


def bin_left_closed(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the `[a, b)` bin; the last bin is open above, values below the lowest edge are null."""
    return _bins(value < edges[0], [value < edge for edge in edges[1:]], value, labels)


def bin_right_closed(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the `(a, b]` bin; the last bin is open above, values at or below the lowest edge are null."""
    return _bins(value <= edges[0], [value <= edge for edge in edges[1:]], value, labels)


def _bins(below: Column, ends: list[Column], value: Column, labels: list[str]) -> Column:
    """One chain of tests from the lowest bin up, so each edge is compared once."""
    chain = F.when(value.isNull() | below, F.lit(None))
    for end, label in zip(ends, labels):
        chain = chain.when(end, F.lit(label))
    return chain.otherwise(F.lit(labels[len(ends)]))


def top_code(value: Column, limit: int) -> Column:
    """Counts from `limit` upward share one label such as `6+`."""
    return F.when(value >= limit, F.lit(f"{limit}+")).otherwise(value.cast("string"))


def any_positive(columns: list[str]) -> Column:
    """True when at least one count column is positive; missing counts are zero."""
    return reduce(lambda a, b: a | b, [positive(c) for c in columns])


def positive(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)) > 0


def row_bucket(key: Column) -> Column:
    """Repeatable pseudo-random number in [0, 1) from an integer id (multiplicative hashing)."""
    return F.pmod(F.pmod(key, F.lit(2**31)) * F.lit(2654435761), F.lit(2**32)) / F.lit(float(2**32))


def normal_tail(z: Column) -> Column:
    """Two-sided normal tail probability of |z|, from a rational approximation of erfc (error below 1.2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for coefficient in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(coefficient) + t * poly
    return t * F.exp(-x * x + poly)


# Published coefficients of the complementary error function fit.
ERFC_COEFFICIENTS = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]
