"""Path filters: extensions, hidden folders, ordered ignore and exclude rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F

from annospark.functions.rules import is_hidden, is_negated, rule_regex, with_parents


#: A line without a rule: blank, or a comment.
NO_RULE = r"^\s*(?:#|$)"


def drop_hidden(df: DataFrame, path: str = "path") -> DataFrame:
    """Rows not below a folder that starts with a dot."""
    return df.where(~is_hidden(F.col(path)))


def parse_rules(lines: DataFrame) -> DataFrame:
    """Rules of an ignore file given as ``(…, seq, line)`` rows: blank and ``#`` lines
    dropped, order kept in ``seq``, a trailing comment stays part of the pattern."""
    rest = [c for c in lines.columns if c != "line"]
    return lines.where(~F.col("line").rlike(NO_RULE)).select(
        *rest, F.col("line").alias("pattern")
    )


def _clean(patterns: Sequence[str]) -> list[str]:
    return [p for p in patterns if not re.match(NO_RULE, p, re.ASCII)]


def _verdict(patterns: Sequence[str]) -> tuple[Callable[[Column], Column] | None, bool]:
    """What the last matching pattern says of one path, and whether any pattern is negated."""
    runs = [
        (negated, F.concat_ws("|", *[rule_regex(F.lit(p)) for p in group]))
        for negated, group in groupby(_clean(patterns), key=lambda p: p.startswith("!"))
    ]
    if not runs:
        return None, False

    def verdict(p: Column) -> Column:
        (negated, regex), *earlier = reversed(runs)
        result = F.when(F.rlike(p, regex), not negated)
        for negated, regex in earlier:
            result = result.when(F.rlike(p, regex), not negated)
        return result.otherwise(False)

    return verdict, any(negated for negated, _ in runs)


def excluded(path: Column, patterns: Sequence[str]) -> Column:
    """True when ordered patterns exclude a path relative to the base.

    The last matching pattern decides, and a folder that is excluded takes along
    all below it.  Runs of same-sign patterns become one regex each, folded to a
    constant before the job starts.
    """
    verdict, negated = _verdict(patterns)
    if verdict is None:
        return F.lit(False)
    return F.exists(with_parents(path), verdict) if negated else verdict(path)


def excluded_folder(path: Column, patterns: Sequence[str]) -> Column:
    """True when ordered patterns exclude a folder, and so all below it; its parents are known not to be."""
    verdict, _ = _verdict(patterns)
    if verdict is None:
        return F.lit(False)
    return verdict(path) | verdict(F.concat(path, F.lit("/")))


def apply_rules(
    paths: DataFrame,
    exclude: Sequence[str] = (),
    ignore: Sequence[str] = (),
    path: str = "path",
    enabled: bool = True,
) -> DataFrame:
    """Rows excluded by neither rule list.  ``enabled=False`` is for a single file
    named by the caller, which no rule applies to."""
    if not enabled:
        return paths
    gone = excluded(F.col(path), exclude) | excluded(F.col(path), ignore)
    return paths.where(~gone)


def compile_rules(rules: DataFrame, *scope: str) -> DataFrame:
    """One row per scope with its runs of rules, from ``(*scope, seq, pattern)`` rows."""
    text = F.col("pattern")
    ordered = F.array_sort(
        F.collect_list(
            F.struct("seq", is_negated(text).alias("negated"), rule_regex(text).alias("regex"))
        )
    )
    per_scope = rules.groupBy(*scope).agg(ordered.alias("rules"))
    plain = ~F.exists("rules", lambda r: r["negated"])
    joined = F.array_join(F.transform("rules", lambda r: r["regex"]), "|")
    one_run = F.array(F.struct(F.lit(False).alias("negated"), joined.alias("regex")))
    runs = F.transform("rules", lambda r: F.struct(r["negated"], r["regex"]))
    return per_scope.select(*scope, plain.alias("plain"), F.when(plain, one_run).otherwise(runs).alias("runs"))


def apply_rule_table(
    paths: DataFrame, rules: DataFrame, scope: Sequence[str], path: str = "path"
) -> DataFrame:
    """Rows not excluded by the rules of their own scope (project, folder, …).

    An equi join on the scope: Spark broadcasts the rules when they are small and
    splits a hot scope when they are not.
    """
    compiled = compile_rules(rules, *scope)

    def verdict(p: Column) -> Column:
        # Patterns cover the whole path; extracting keeps the last one compiled.
        return F.aggregate(
            F.col("runs"),
            F.lit(False),
            lambda out, r: F.when(
                F.regexp_substr(p, r["regex"]).isNotNull(), ~r["negated"]
            ).otherwise(out),
        )

    gone = F.when(F.col("plain"), verdict(F.col(path))).otherwise(
        F.exists(with_parents(F.col(path)), verdict)
    )
    joined = paths.join(compiled, list(scope), "left")
    return joined.where(F.col("runs").isNull() | ~gone).select(*paths.columns)
