"""Generate docstrings for a corpus and merge them into it."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from annospark.functions.text import clean
from annospark.functions.validate import validate, validate_by_style
from annospark.operators import chunks, coverage, diff, generate, merge, prompts, runs, scan
from annospark.plans.report import selected
from annospark.sources.changes import changed_only
from annospark.sources.shared import shared_folder

#: What of a function's place an edit needs.
PLACE = (
    "path", "line_number", "name", "parent_class", "one_line", "has_docstring",
    "body_indent", "doc_rest", "header_end", "doc_end",
)
EDIT = ("path", "line_number", "name", "parent_class", "outcome", "error", "after", "upto", "text")
ROUTE = ("provider", "model", "base_url")


@dataclass(frozen=True)
class Run:
    """Tables a run gives back.  The scan, the answers and one outcome per record are written."""

    corpus: DataFrame
    outcomes: DataFrame
    errors: DataFrame
    stats: DataFrame
    edits: DataFrame
    generations: DataFrame

    def preview(self, files: DataFrame, context: int = 3) -> DataFrame:
        """Unified diff per file, for a dry run."""
        return diff.unified(files, self.edits, context)


def annotate(
    files: DataFrame,
    make_client: Callable[..., Callable[[str], str]],
    style: str = "google",
    overwrite: bool = False,
    only_missing: bool = False,
    max_retries: int = 3,
    tasks: int | None = None,
    clean_first: bool = False,
    generations_path: str | None = None,
    sleep: Callable[[float], None] = time.sleep,
    dry_run: bool = False,
    batch_size: int = chunks.BATCH,
    extensions: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    ignore: Sequence[str] = (),
    changes: DataFrame | None = None,
    settings: DataFrame | None = None,
    project: Column | None = None,
    rates: Mapping[str, float] | None = None,
) -> Run:
    """Scan, prompt, generate, validate, clean and merge.

    Answers are kept at ``generations_path`` (by default a table in the shared folder) in chunks
    of ``batch_size``, so a lost task pays for one chunk again at most, and a later run with
    the same path asks only for prompts it does not hold yet.  ``dry_run`` plans the edits
    as if overwriting and leaves the corpus as it is.

    ``extensions``, ``exclude`` and ``ignore`` say which files the run looks at, as in a report;
    ``changes`` (path, status, ts) narrows them to changed ones.  All other files stay as they are.

    ``settings`` has one row per project, such as ``settings.resolve`` gives: its ``style`` is used for
    prompts and checks (``style`` where it has none), and its provider, model and base_url choose
    the client, made as ``make_client(provider=…, model=…, base_url=…)``.  A column ``has_key`` may say
    whether a key is at hand; without it one is taken to be.  ``project`` gives a path's project, by
    default its first folder.  ``rates`` bounds calls per second by provider.
    """
    spark = files.sparkSession
    seen = files if changes is None else changed_only(files, changes)
    if extensions is not None or exclude or ignore:
        seen = selected(seen, extensions if extensions is not None else (".py",), exclude, ignore)
    overwriting = overwrite or dry_run

    # One pass over the source; prompts, outcomes, errors and counters all read its result.
    scan_path = shared_folder(spark, "scan")
    _asked(scan.scanned(seen), style, only_missing, settings, project).write.parquet(scan_path)
    scan_rows = spark.read.parquet(scan_path)
    status, asked = scan.status_of(scan_rows), scan_rows.where(F.col("prompt_key").isNotNull())

    path = generations_path or shared_folder(spark, "generations")
    work, route = asked, ()
    if settings is not None:
        work, route = generate.route(asked.select("project", "prompt", "prompt_key"), _complete(settings)), ROUTE
    generations = chunks.answer_all(
        work, make_client, path, batch_size, max_retries, tasks, sleep, route=route, rates=rates
    )

    # One outcome per record, through one chain of columns.
    outcome_path = shared_folder(spark, "outcomes")
    answered = asked.drop("prompt", "error").join(chunks.best(generations), "prompt_key")
    by_project = None if settings is None else F.col("style")
    _outcomes(answered, style, by_project, clean_first, overwriting).write.parquet(outcome_path)
    outcomes = spark.read.parquet(outcome_path)
    edit_rows = outcomes.where(F.coalesce(F.col("stage") == "Patch error", F.lit(True))).select(*EDIT)
    failed = outcomes.where(F.col("stage").isNotNull()).select(
        "path", F.col("line_number").alias("line"), "stage", F.col("error").alias("message")
    )
    counted = runs.stats(outcomes, status)
    if dry_run:
        none = F.lit(0).cast("long")
        counted = counted.withColumn("added", none).withColumn("updated", none)
    return Run(
        files.select("path", "source") if dry_run else merge.apply_all(files, edit_rows),
        outcomes.select("path", "line_number", "outcome", "error", "stage"),
        runs.all_errors(coverage.parse_errors(status), failed),
        counted, edit_rows, generations,
    )


def _complete(settings: DataFrame) -> DataFrame:
    """Settings with the columns that a route needs."""
    for name in (*ROUTE, "style"):
        if name not in settings.columns:
            settings = settings.withColumn(name, F.lit(None).cast("string"))
    if "has_key" not in settings.columns:
        settings = settings.withColumn("has_key", F.lit(True))
    return settings


def _asked(
    found: DataFrame, style: str, only_missing: bool, settings: DataFrame | None, project: Column | None
) -> DataFrame:
    """``scan.scanned`` rows with ``prompt`` and ``prompt_key`` where one is asked for."""
    columns = [*dict.fromkeys(["error_line", "error", "nth", "is_class", *PLACE]), "prompt", "prompt_key"]
    chosen: str | Column = style
    if settings is not None:
        of_path = F.substring_index("path", "/", 1) if project is None else project
        places = _complete(settings).select("project", F.col("style").alias("_style"), *[F.col(c).alias(f"_{c}") for c in ROUTE])
        found = found.withColumn("project", of_path).join(places, "project", "left")
        chosen = F.coalesce("_style", F.lit(style))
        columns += ["project", "style"]
    wanted = F.col("line_number").isNotNull() & ~F.col("is_class")
    if only_missing:
        wanted = wanted & ~F.col("has_docstring")
    rows = prompts.prompts(found.withColumn("style", F.lit(chosen) if isinstance(chosen, str) else chosen), F.col("style"))
    if settings is not None:  # the same prompt for another model is another prompt
        places = [F.coalesce(f"_{c}", F.lit("")) for c in ROUTE]
        rows = rows.withColumn("prompt_key", F.sha2(F.concat_ws("\n", *places, "prompt"), 256))
    return rows.withColumns({c: F.when(wanted, F.col(c)) for c in ("prompt", "prompt_key")}).select(*columns)


def _outcomes(
    answered: DataFrame, style: str, by_project: Column | None, clean_first: bool, overwriting: bool
) -> DataFrame:
    """One row per asked record: its outcome, what went wrong at which stage, and its edit."""
    raw, ok = F.col("answer"), F.col("status") == generate.OK
    text = clean(raw) if clean_first else raw
    check = validate(text, style) if by_project is None else validate_by_style(text, by_project)
    rows = answered.withColumn("check", F.when(ok, check))
    valid = ok & F.col("check.valid")
    rows = rows.withColumn("docstring", F.when(valid, clean(raw)))
    rows = rows.withColumn("edit", F.struct(*merge.edit_columns(overwriting)))
    stage = (
        F.when(~ok, "LLM error").when(~valid, "Validation failed").when(F.col("edit.error").isNotNull(), "Patch error")
    )
    error = F.when(~ok, F.col("error")).when(~valid, F.col("check.error")).otherwise(F.col("edit.error"))
    return rows.select(
        "path", "line_number", "name", "parent_class", stage.alias("stage"), error.alias("error"),
        F.when(stage.isNotNull(), "error").otherwise(F.col("edit.outcome")).alias("outcome"),
        *[F.when(valid, F.col(f"edit.{c}")).alias(c) for c in ("after", "upto", "text")],
    )
