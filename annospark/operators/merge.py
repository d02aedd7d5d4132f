"""Put annotations into records, and docstrings into source text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from annospark.functions.binding import let
from annospark.functions.cached import per_context
from annospark.functions.lexical import unix_newlines
from annospark.functions.text import quotable, quote
from annospark.operators import scan

ADDED, UPDATED, UNCHANGED = "added", "updated", "unchanged"


def overwrite_policy(records: DataFrame, overwrite: bool, flag: str = "has_docstring") -> DataFrame:
    """Records a run may change: all with ``overwrite``, else those without annotation."""
    return records if overwrite else records.where(~F.col(flag))


def merge(
    records: DataFrame,
    new: DataFrame,
    key: str | Sequence[str],
    old_value: str,
    new_value: str,
    overwrite: bool = False,
) -> DataFrame:
    """Every record with ``merged`` (the value to keep) and ``outcome``.

    ``new`` holds at most one row per key.  Keys compare null-safe, so a name and a
    null class is a valid key.
    """
    on = [key] if isinstance(key, str) else list(key)
    right = new.select(
        *[F.col(k).alias(f"_k_{k}") for k in on],
        F.col(new_value).alias("_new"),
        F.lit(True).alias("_hit"),
    )
    match = F.lit(True)
    for k in on:
        match = match & records[k].eqNullSafe(right[f"_k_{k}"])
    has_old = F.col(old_value).isNotNull()
    take = F.col("_hit").isNotNull() & (~has_old | F.lit(overwrite))
    return (
        records.join(right, match, "left")
        .withColumn("merged", F.when(take, F.col("_new")).otherwise(F.col(old_value)))
        .withColumn(
            "outcome",
            F.when(take & has_old, UPDATED).when(take, ADDED).otherwise(UNCHANGED),
        )
        .select(*records.columns, "merged", "outcome")
    )


def targets(
    sites: DataFrame, new: DataFrame, by_name: bool = False
) -> DataFrame:
    """Sites with the ``docstring`` meant for them.

    By default a docstring names its place by (path, line_number).  ``by_name``
    matches (path, name, parent_class) instead, null class being module level.
    Of several docstrings for one place the smallest text is taken.
    """
    place = ["path", "name", "parent_class"] if by_name else ["path", "line_number"]
    new = new.groupBy(*place).agg(F.min("docstring").alias("docstring"))
    if not by_name:
        return sites.join(new.select("path", "line_number", "docstring"), ["path", "line_number"])
    right = new.select(
        F.col("path").alias("_path"), F.col("name").alias("_name"),
        F.col("parent_class").alias("_class"), "docstring",
    )
    match = (
        (sites["path"] == right["_path"])
        & (sites["name"] == right["_name"])
        & sites["parent_class"].eqNullSafe(right["_class"])
    )
    return sites.join(right, match).drop("_path", "_name", "_class")


def edits(targeted: DataFrame, overwrite: bool = False) -> DataFrame:
    """One row per targeted function: its ``outcome`` and, where it changes, the edit.

    After line ``after`` of the file, lines up to ``upto`` are removed and ``text``
    is put in.  A function whose body is on the header line cannot take a docstring, nor can
    any that would not be read as one literal; that is an error on the row.
    """
    return targeted.select("path", "line_number", "name", "parent_class", *edit_columns(overwrite))


@per_context
def edit_columns(overwrite: bool) -> list[Column]:
    """``outcome, error, after, upto, text`` of rows with a place and its ``docstring``."""
    wanted = ~F.col("has_docstring") | F.lit(overwrite)
    broken = ~F.col("one_line") & wanted & ~F.coalesce(quotable(quote(F.col("docstring"))), F.lit(True))
    change = ~F.col("one_line") & wanted & ~broken
    literal = F.concat("body_indent", quote(F.col("docstring")))
    rest = F.coalesce("doc_rest", F.lit(""))
    text = F.concat(
        literal, F.when(rest != "", F.concat(F.lit("\n"), "body_indent", rest)).otherwise("")
    )
    return [
        F.when(F.col("one_line") | broken, "error")
        .when(change & F.col("has_docstring"), UPDATED)
        .when(change, ADDED)
        .otherwise(UNCHANGED)
        .alias("outcome"),
        F.when(F.col("one_line"), "Failed to patch file: body is on the header line")
        .when(broken, "Failed to patch file: docstring is not one literal")
        .alias("error"),
        F.when(change, F.col("header_end")).alias("after"),
        F.when(change, F.coalesce("doc_end", "header_end")).alias("upto"),
        F.when(change, text).alias("text"),
    ]


def edits_by_file(edit_rows: DataFrame) -> DataFrame:
    """The changing edits of a file as one array in line order."""
    return (
        edit_rows.where(F.col("text").isNotNull())
        .groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct("after", "upto", "text"))).alias("edits"))
    )


def source_lines(source: Column) -> Column:
    return F.split(unix_newlines(source), "\n")


@per_context
def _patched_source() -> Column:
    return patched(F.col("source"), F.col("edits"))


def patched(source: Column, edit_list: Column) -> Column:
    """Source with an ordered list of edits: the stretches between them are cut out
    of the line array and joined again, every other line untouched."""
    kept_from = F.concat(F.array(F.lit(0)), F.transform(edit_list, lambda e: e["upto"]))

    def rebuilt(b: Column) -> Column:
        lines, kept = b["lines"], b["kept_from"]
        stretches = F.transform(
            edit_list,
            lambda e, i: F.concat(
                F.slice(lines, F.get(kept, i) + 1, e["after"] - F.get(kept, i)),
                F.array(e["text"]),
            ),
        )
        done = F.element_at(kept, -1)
        tail = F.slice(lines, done + 1, F.greatest(F.size(lines) - done, F.lit(0)))
        return F.array_join(F.concat(F.flatten(stretches), tail), "\n")

    return let(
        F.struct(source_lines(source).alias("lines"), kept_from.alias("kept_from")), rebuilt
    )


def apply_edits(files: DataFrame, edit_rows: DataFrame) -> DataFrame:
    """Changed files only: ``path, source`` with all edits of a file made at once."""
    return files.join(edits_by_file(edit_rows), "path").select(
        "path", _patched_source().alias("source")
    )


def apply_all(files: DataFrame, edit_rows: DataFrame) -> DataFrame:
    """The whole corpus, changed where it has edits."""
    joined = files.join(edits_by_file(edit_rows), "path", "left")
    done = F.when(F.col("edits").isNull(), F.col("source")).otherwise(_patched_source())
    return joined.select("path", done.alias("source"))


def inject(
    files: DataFrame, new: DataFrame, overwrite: bool = False, by_name: bool = False
) -> DataFrame:
    """The whole corpus with the docstrings of ``new`` in place."""
    return apply_all(files, edits(targets(scan.function_sites(files), new, by_name), overwrite))
