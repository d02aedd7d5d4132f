"""Outcome of a run as tables: counters and errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ERROR_COLUMNS = ("path", "line", "stage", "message")


def stats(outcomes: DataFrame, status: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """One row: ``files_processed, added, updated, errors``.

    ``outcomes`` has a row ``(path, outcome)`` per record.  With ``status`` (rows of
    ``scan.parse_status``) files are counted there, those without records included,
    and unreadable files count as errors.  ``compat`` counts an unchanged record,
    which is one that had its annotation already, as updated.
    """
    updated = F.col("outcome") == "updated"
    if compat:
        updated = updated | (F.col("outcome") == "unchanged")
    counted = outcomes.agg(
        F.count_distinct("path").alias("files_processed"),
        F.count_if(F.col("outcome") == "added").alias("added"),
        F.count_if(updated).alias("updated"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )
    if status is None:
        return counted
    none = F.lit(0).cast("long")
    files = status.agg(
        F.count_if(F.col("error").isNull()).alias("files_processed"),
        none.alias("added"),
        none.alias("updated"),
        F.count("error").alias("errors"),
    )
    both = counted.withColumn("files_processed", none).unionByName(files)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def error_location(path: Column, line: Column) -> Column:
    return F.when(line.isNull(), path).otherwise(F.concat_ws(":", path, line.cast("string")))


def error_lines(errors: DataFrame) -> DataFrame:
    """``path:line - Stage: message``, without ``:line`` for a file-level error."""
    place = error_location(F.col("path"), F.col("line"))
    return errors.select(
        F.concat(place, F.lit(" - "), "stage", F.lit(": "), "message").alias("value")
    )


def split_error(text: Column) -> Column:
    """``struct(location, message)``, split at the first ``" - "``; a text without it
    is all message."""
    parts = F.split(text, " - ", 2)
    split = F.size(parts) == 2
    return F.struct(
        F.when(split, F.get(parts, F.lit(0))).otherwise("").alias("location"),
        F.when(split, F.get(parts, F.lit(1))).otherwise(text).alias("message"),
    )


def all_errors(*frames: DataFrame) -> DataFrame:
    """Errors of all stages in one table."""
    return reduce(DataFrame.unionByName, [f.select(*ERROR_COLUMNS) for f in frames])


def errors_by_stage(errors: DataFrame) -> DataFrame:
    return errors.groupBy("stage").agg(F.count("*").alias("n"))


def record_errors(rows: DataFrame, stage: str, message: str = "error") -> DataFrame:
    """Error rows of a record-level stage: where ``message`` is not null."""
    return rows.where(F.col(message).isNotNull()).select(
        "path",
        F.col("line_number").alias("line"),
        F.lit(stage).alias("stage"),
        F.col(message).alias("message"),
    )
