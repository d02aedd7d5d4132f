"""Coverage report over a corpus, from path rules to the gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from annospark.operators import coverage, rules
from annospark.sources.corpus import by_extension


def selected(
    corpus: DataFrame,
    extensions: Sequence[str] = (".py",),
    exclude: Sequence[str] = (),
    ignore: Sequence[str] = (),
) -> DataFrame:
    """Corpus rows a run looks at.  All are row filters on ``path``; they reach the
    scan, before any source text is touched."""
    found = rules.drop_hidden(by_extension(corpus, extensions))
    return rules.apply_rules(found, exclude, ignore)


def coverage_report(
    corpus: DataFrame,
    extensions: Sequence[str] = (".py",),
    exclude: Sequence[str] = (),
    ignore: Sequence[str] = (),
    min_pct: float | None = None,
    require_all: bool = False,
) -> DataFrame:
    """One row: totals, percentage, unreadable files and whether the gate passes."""
    files = selected(corpus, extensions, exclude, ignore)
    return coverage.gate(coverage.report(files), min_pct, require_all)
