"""Type repair of raw claims: one projection, absent columns skipped, already typed columns kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlab.functions import columns as X
from claimlab.schema import (
    CODE_STRING_COLUMNS,
    CODED_INTEGER_COLUMNS,
    COUNTRY_COLUMNS,
    CURRENCY_COLUMNS,
    DECIMAL_COLUMNS,
    LONG_CODE_COLUMNS,
)


def _present(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _currency(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    return {
        c: X.currency(F.col(c)) if _is_text(df, c) else F.col(c).cast("double") for c in _present(df, columns)
    }


def _coded_integers(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    casts = {
        c: X.coded_integer(F.col(c), _is_text(df, c), "long" if c in LONG_CODE_COLUMNS else "int")
        for c in _present(df, columns)
        if not isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType))
    }
    return casts | {c: X.number(F.col(c)) for c in _present(df, DECIMAL_COLUMNS) if _is_text(df, c)}


def _code_strings(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    return {c: X.code_string(F.col(c)) for c in _present(df, columns)}


def _countries(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    return {c: X.country_string(F.col(c)) for c in _present(df, columns)}


def clean_currency(df: DataFrame, columns: list[str] = CURRENCY_COLUMNS) -> DataFrame:
    """Dollar text to double."""
    return df.withColumns(_currency(df, columns))


def clean_coded_integers(df: DataFrame, columns: list[str] = CODED_INTEGER_COLUMNS) -> DataFrame:
    """Coded numbers to nullable integers; the action length keeps its decimals."""
    return df.withColumns(_coded_integers(df, columns))


def clean_code_strings(df: DataFrame, columns: list[str] = CODE_STRING_COLUMNS) -> DataFrame:
    """Code strings trimmed, upper-cased, blanks to null."""
    return df.withColumns(_code_strings(df, columns))


def clean_countries(df: DataFrame, columns: list[str] = COUNTRY_COLUMNS) -> DataFrame:
    """Deprecated country columns as text."""
    return df.withColumns(_countries(df, columns))


def clean_claims(df: DataFrame) -> DataFrame:
    """Standard cleaning of every known column in one projection; the rules touch disjoint columns."""
    return df.withColumns(
        _currency(df, CURRENCY_COLUMNS)
        | _coded_integers(df, CODED_INTEGER_COLUMNS)
        | _code_strings(df, CODE_STRING_COLUMNS)
        | _countries(df, COUNTRY_COLUMNS)
    )
