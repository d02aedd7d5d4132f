"""Path rules by the thousand: each path meets only the rules that could match it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from annospark.functions.rules import is_negated, rule_regex, with_parents

#: What makes a segment of a pattern more than its own name.
_SPECIAL = r"[*?\[\]\\]"


def rule_key(pattern: Column) -> Column:
    """A literal part that every path a pattern matches has: its first folders (``h:…``) or one name (``n:…``).

    Null where a pattern has neither, such as ``*.pyc``.
    """
    body = F.regexp_replace(F.regexp_replace(pattern, r"(?<!\\)[ \t]+$", ""), r"^!", "")
    body = F.regexp_replace(body, r"/$", "")
    anchored = body.contains("/")
    body = F.regexp_replace(body, r"^/", "")
    anywhere = F.when(anchored, F.regexp_extract(body, r"^\*\*/([^/]+)", 1)).otherwise(body)
    head = F.when(~body.rlike(_SPECIAL), body).otherwise(
        F.regexp_replace(F.regexp_extract(body, r"^(?:[^*?\[\]\\/]+/)+", 0), r"/$", ""))
    named = (anywhere != "") & ~anywhere.rlike(_SPECIAL)
    return F.when(named, F.concat(F.lit("n:"), anywhere)).when(anchored & (head != ""), F.concat(F.lit("h:"), head))


def path_keys(path: Column) -> Column:
    """All keys a rule that matches the path, or one of its parents, may have."""
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("h:"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.array_distinct(F.concat(heads, F.transform(parts, lambda s: F.concat(F.lit("n:"), s))))


def apply_rule_index(paths: DataFrame, rules: DataFrame, scope: Sequence[str], path: str = "path") -> DataFrame:
    """As ``rules.apply_rule_table``, for scopes of very many rules: same result, other plan.

    Rules (``*scope, seq, pattern``) with a literal part are joined to the paths by equality of scope
    and part and tested there; only those that match travel on.  Rules without one
    are tested by every path of their scope.  Rows with a null scope or path are kept, repeated rows too.
    """
    text, scope = F.col("pattern"), list(scope)
    keyed = rules.select(*scope, "seq", is_negated(text).alias("negated"), rule_regex(text).alias("regex"), rule_key(text).alias("key"))
    rule = F.struct("seq", "negated", "regex")
    per_scope = keyed.groupBy(*scope).agg(
        F.bool_or("negated").alias("signed"), F.array_sort(F.collect_list(F.when(F.col("key").isNull(), rule))).alias("open"))
    once = paths.select(*scope, F.col(path).alias("_path")).where("_path is not null").distinct()

    hit = F.exists(with_parents(F.col("_path")), lambda p: F.regexp_substr(p, F.col("regex")).isNotNull())
    met = once.withColumn("key", F.explode(path_keys(F.col("_path")))).join(keyed.where("key is not null"), [*scope, "key"])
    met = met.where(hit).groupBy(*scope, "_path").agg(F.collect_list(rule).alias("met"))

    none = F.array().cast("array<struct<seq:bigint,negated:boolean,regex:string>>")
    listed = F.array_sort(F.concat(F.coalesce("open", none), F.coalesce("met", none)))
    judged = once.join(per_scope, scope).join(met, [*scope, "_path"], "left").select(*scope, "_path", "signed", listed.alias("rules"))

    def verdict(p: Column) -> Column:
        return F.aggregate("rules", F.lit(False), lambda out, r: F.when(
            F.regexp_substr(p, r["regex"]).isNotNull(), ~r["negated"]).otherwise(out))

    gone = F.when(F.col("signed"), F.exists(with_parents(F.col("_path")), verdict)).otherwise(verdict(F.col("_path")))
    out = judged.where((F.size("rules") > 0) & gone).select(*scope, F.col("_path").alias(path))
    return paths.join(out, [*scope, path], "left_anti").select(*paths.columns)
