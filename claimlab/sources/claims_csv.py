"""Reader for the public claims CSV: one file or a folder of files whose headers can differ."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlab.functions import columns as X
from claimlab.schema import CLAIMS_SCHEMA

#: Distinct headers that one call reconciles; each is a scan of its own files.
HEADER_LIMIT = 200
_MALFORMED = "_malformed_line"
_FILE = "_source_file"


def file_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of each distinct header. Only the first line of every file comes to the driver."""
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    first = lines.where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value"
    )
    heads = first.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    by_header = heads.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in by_header.limit(HEADER_LIMIT + 1).collect():
        names = tuple(next(csv.reader([row["header"].lstrip("\ufeff").rstrip("\r")]), ()))
        if len(set(names)) < len(names):
            raise ValueError(f"a header names a column twice: {names}")
        found.setdefault(names, []).extend(unquote(f) for f in row["files"])
    if len(found) > HEADER_LIMIT:
        raise ValueError(f"more than {HEADER_LIMIT} different headers")
    return found


def _cells(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every file's cells as text under the names of its own header, with its path and, if malformed, the line."""
    parts = []
    for names, files in file_headers(spark, path).items():
        own = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _MALFORMED)])
        text = (
            spark.read.schema(own)
            .option("header", True)
            .option("enforceSchema", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", _MALFORMED)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(files)
        )
        present = [F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast("string").alias(f.name) for f in schema]
        # A parser that is asked for some cells does not count the others, so the line goes with nothing of all cells.
        nothing = F.substring(F.concat_ws("", *[f"`{n}`" for n in names]), 1, 0)
        parts.append(text.select(*present, F.concat(_MALFORMED, nothing).alias(_MALFORMED), F.col("_metadata.file_path").alias(_FILE)))
    if not parts:
        empty = T.StructType([T.StructField(n, T.StringType()) for n in (*schema.names, _MALFORMED, _FILE)])
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)


def _is_malformed() -> Column:
    # A plain null test would be pushed into the parser, which applies it before it knows the line.
    return F.length(F.coalesce(F.col(_MALFORMED), F.lit(""))) > 0


def read_claims_csv(
    spark: SparkSession, path: str, schema: T.StructType = CLAIMS_SCHEMA, typed: bool = True
) -> DataFrame:
    """Read claims CSV files, each by its own header: any column order, absent columns null, other columns left out.

    Every cell is read as text, so nothing is lost before it is looked at. Whole-number columns are then rounded
    to their type, which takes `9.0` as 9; `typed=False` leaves them as text for `audit.type_conformity`. Dollar
    and coded columns stay text either way; `clean_claims` types them. Lines with more or fewer cells than their
    file's header are not claims; `malformed_lines` gives them.
    """
    cells = _cells(spark, path, schema).where(~_is_malformed())
    return cells.select(*[(_typed(F.col(f.name), f) if typed else F.col(f.name)).alias(f.name) for f in schema])


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType = CLAIMS_SCHEMA) -> DataFrame:
    """File and text of every line whose number of cells is not that of its file's header."""
    cells = _cells(spark, path, schema).where(_is_malformed())
    return cells.select(F.col(_FILE).alias("file"), F.col(_MALFORMED).alias("line"))


def parse_claims_lines(lines: DataFrame, column: str, schema: T.StructType = CLAIMS_SCHEMA) -> DataFrame:
    """Parse a column of headerless claims CSV lines, in the order of `schema`, by the rules of the file reader."""
    as_text = ", ".join(f"{field.name} string" for field in schema)
    parsed = F.from_csv(F.col(column), F.lit(as_text), {"mode": "PERMISSIVE"})
    cells = lines.select(parsed.alias("claim")).select("claim.*")
    return cells.select(*[_typed(F.col(field.name), field).alias(field.name) for field in schema])


def _typed(cell: Column, field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return cell
    return X.coded_integer(cell, True, field.dataType.simpleString())
