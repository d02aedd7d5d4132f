"""How many records carry an annotation, and where it is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from annospark.operators import scan

FLAG = "has_docstring"


def percentage(part: Column, total: Column) -> Column:
    """Share in percent; 0.0 when there is nothing to count."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total * 100)


def _with_percentage(totals: DataFrame) -> DataFrame:
    return totals.withColumn("coverage_pct", percentage(F.col("documented"), F.col("total")))


def _counts(flag: str) -> list[Column]:
    return [F.count(flag).alias("total"), F.count_if(F.col(flag)).alias("documented")]


def coverage(records: DataFrame, flag: str = FLAG) -> DataFrame:
    """One row: ``total, documented, coverage_pct``."""
    return _with_percentage(records.agg(*_counts(flag)))


def coverage_by(
    records: DataFrame, *keys: str, flag: str = FLAG, rollup: bool = False
) -> DataFrame:
    """Coverage per group; with ``rollup`` also per prefix of the keys and overall
    (``level`` tells how many keys were rolled up)."""
    if not rollup:
        return _with_percentage(records.groupBy(*keys).agg(*_counts(flag)))
    level = F.bit_count(F.grouping_id()).cast("int").alias("level")
    return _with_percentage(records.rollup(*keys).agg(*_counts(flag), level))


def missing(records: DataFrame, flag: str = FLAG, line: str = "line_number") -> DataFrame:
    """``path, line`` of the records without an annotation."""
    return records.where(~F.col(flag)).select("path", F.col(line).alias("line"))


def missing_by_file(records: DataFrame, flag: str = FLAG) -> DataFrame:
    """The same as one sorted list per file."""
    return missing(records, flag).groupBy("path").agg(
        F.array_sort(F.collect_list("line")).alias("lines")
    )


def report(files: DataFrame) -> DataFrame:
    """Coverage of a corpus in one pass: ``total, documented, coverage_pct`` and
    ``skipped_files``, the files that cannot be read."""
    rows = scan.records(scan.headers(files))
    is_function = F.col("line_number").isNotNull() & ~F.col("is_class")
    return _with_percentage(
        rows.agg(
            F.count_if(is_function).alias("total"),
            F.count_if(is_function & F.col("has_docstring")).alias("documented"),
            F.count("error").alias("skipped_files"),
        )
    )


def parse_errors(status: DataFrame) -> DataFrame:
    """Dead letters ``path, line, stage, message`` from file status rows."""
    message = F.concat_ws(
        "", F.lit("Failed to parse file: "), "error", F.lit(" at line "),
        F.col("error_line").cast("string"),
    )
    return status.where(F.col("error").isNotNull()).select(
        "path",
        F.lit(None).cast("int").alias("line"),
        F.lit("Parse error").alias("stage"),
        message.alias("message"),
    )


def split_parse_errors(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable paths, and the dead letters."""
    status = scan.parse_status(files)
    return status.where(F.col("error").isNull()).select("path"), parse_errors(status)


def gate(
    report_df: DataFrame, min_pct: float | None = None, require_all: bool = False
) -> DataFrame:
    """Adds ``missing`` and ``passed``: coverage at or above ``min_pct`` and, with
    ``require_all``, nothing missing."""
    gap = F.col("total") - F.col("documented")
    passed = F.lit(True)
    if min_pct is not None:
        passed = passed & (F.col("coverage_pct") >= F.lit(float(min_pct)))
    if require_all:
        passed = passed & (gap == 0)
    return report_df.withColumn("missing", gap).withColumn("passed", passed)


def missing_top(
    missing_df: DataFrame, k: int = 10, order: Sequence[str] = ("path", "line")
) -> DataFrame:
    """The first ``k`` gaps as text, and a row "... and N more" when there are more.

    ``rank`` gives the order.  The top k are kept per task and merged, so no task
    sees more than k rows of each other task.
    """
    first = missing_df.orderBy(*order).limit(k)
    packed = first.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("rows"))
    ranked = packed.select(F.posexplode("rows")).select(
        (F.col("pos") + 1).alias("rank"),
        F.format_string("- `%s:%d`", "col.path", "col.line").alias("text"),
    )
    more = (
        missing_df.agg((F.count("*") - k).alias("n"))
        .where(F.col("n") > 0)
        .select(F.lit(k + 1).alias("rank"), F.format_string("... and %d more", "n").alias("text"))
    )
    return ranked.unionByName(more)


def annotations(missing_df: DataFrame) -> DataFrame:
    """Line for a build log per gap."""
    text = F.format_string("::warning file=%s,line=%d::Missing docstring", "path", "line")
    return missing_df.select(text.alias("value"))


def report_json(report_df: DataFrame) -> DataFrame:
    """The totals as one JSON text."""
    doc = F.struct(
        F.col("total").alias("total_functions"),
        F.col("documented").alias("documented_functions"),
        F.col("coverage_pct").alias("coverage_percentage"),
    )
    return report_df.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))


def file_report_json(records: DataFrame, flag: str = FLAG) -> DataFrame:
    """One JSON text per file, with the list of its gaps.

    A list over the whole corpus would grow without bound in one row; per file it
    cannot.
    """
    lines = F.array_sort(F.collect_list(F.when(~F.col(flag), F.col("line_number"))))
    per_file = _with_percentage(
        records.groupBy("path").agg(*_counts(flag), lines.alias("lines"))
    )
    doc = F.struct(
        F.col("total").alias("total_functions"),
        F.col("documented").alias("documented_functions"),
        F.col("coverage_pct").alias("coverage_percentage"),
        F.transform("lines", lambda n: F.struct(F.col("path"), n.alias("line"))).alias(
            "missing_docstrings"
        ),
    )
    return per_file.select("path", F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))


def only_missing(
    records: DataFrame,
    annotations_df: DataFrame | None = None,
    key: str | Sequence[str] | None = None,
    flag: str = FLAG,
) -> DataFrame:
    """Records without an annotation: by their flag, or by absence from a table."""
    if annotations_df is None:
        return records.where(~F.col(flag))
    on = [key] if isinstance(key, str) else list(key)
    return records.join(annotations_df.select(*on).distinct(), on, "left_anti")


def annotated(records: DataFrame, annotations_df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Adds the flag: does the annotation table hold the record's key?

    The annotation side is reduced to distinct keys map-side before it moves; Spark
    broadcasts it when small, else a hot record key is split by AQE.
    """
    on = [key] if isinstance(key, str) else list(key)
    marks = annotations_df.select(*on).distinct().withColumn("_mark", F.lit(True))
    flagged = records.join(marks, on, "left")
    return flagged.withColumn(FLAG, F.col("_mark").isNotNull()).drop("_mark")


def annotation_coverage(
    records: DataFrame,
    annotations_df: DataFrame,
    key: str | Sequence[str],
    by: Sequence[str] = (),
    rollup: bool = False,
) -> DataFrame:
    """Coverage of any keyed table by any table of annotations."""
    flagged = annotated(records, annotations_df, key)
    return coverage_by(flagged, *by, rollup=rollup) if by else coverage(flagged)
