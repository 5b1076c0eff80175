"""Delimited files with a header row into raw tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Clock
from tidemark.schemas import INGESTED
from tidemark.sources.shared import materialise
from tidemark.sources.tables import append_batch, replace_table


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None,
    sep: str = "|",
    **opts: object,
) -> DataFrame:
    """Scan delimited files; `path` may be a glob or a list.

    With a schema the files are read once and the header must name the same
    columns. `schema=None` opts in to inference, which costs an extra pass.
    Further keyword arguments go to the reader unchanged and win over the defaults.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    if schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.options(**opts).csv(path)


def stamp_ingest(df: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    return df.withColumn(INGESTED, Clock(now=now).instant().cast("timestamp"))


def load_raw(
    spark: SparkSession,
    path: str | list[str],
    table: str,
    schema: T.StructType | None,
    now: dt.datetime | None = None,
    append: bool = False,
    **opts: object,
) -> None:
    """Files to a raw table. Replacing it stamps every row anew, so a re-seed marks every
    customer as changed; appended, only the customers in these files are."""
    rows = stamp_ingest(read_delimited(spark, path, schema, **opts), now)
    if append:
        append_batch(rows, table)
    else:
        replace_table(rows, table)


LINE, FILE, REASONS, TEXT_SUFFIX = "_line", "_file", "_reasons", "_text"


def read_checked(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    sep: str = "|",
    keep_text: tuple[str, ...] = (),
    header: bool = True,
    **opts: object,
) -> DataFrame:
    """Every line of delimited files with what is wrong with it.

    The declared columns, NULL where the text is no such value; for columns of `keep_text`
    also `<column>_text`, the text as delivered; `_reasons`, an empty array for a good line,
    else `columns` when the number of fields differs from the schema's and the names of
    columns whose text cannot be cast; `_line`, the line of a rejected one; and `_file`.
    Nothing fails on a bad line. Empty fields are NULL and never a reason.
    """
    names = schema.names
    as_text = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(LINE, T.StringType())])
    reader = spark.read.schema(as_text).option("header", header).option("sep", sep).option("enforceSchema", True)
    raw = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE).options(**opts).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias(FILE))

    def cast(field: T.StructField) -> Column:
        return F.col(f"`{field.name}`").try_cast(field.dataType)

    wrong = [F.when(F.col(LINE).isNotNull(), F.lit("columns"))]
    for f in schema:
        if not isinstance(f.dataType, T.StringType):
            wrong.append(F.when(F.col(f"`{f.name}`").isNotNull() & cast(f).isNull(), F.lit(f.name)))
    reasons = F.filter(F.array(*wrong), lambda r: r.isNotNull())
    line = F.coalesce(F.col(LINE), F.concat_ws(sep, *(F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names)))
    return raw.select(
        *(cast(f).alias(f.name) for f in schema),
        *(F.col(f"`{c}`").alias(f"{c}{TEXT_SUFFIX}") for c in keep_text),
        reasons.alias(REASONS),
        F.when(F.size(reasons) > 0, line).alias(LINE),
        FILE,
    )


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines with their reasons), from lines parsed once: they are
    stored in between, so the files are not read again for the second sink."""
    stored = materialise(checked, "checked")
    bad = F.size(REASONS) > 0
    good = stored.where(~bad).drop(REASONS, LINE, FILE)
    return good, stored.where(bad).select(LINE, REASONS, FILE)
