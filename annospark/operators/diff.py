"""Differences between two versions, from keys, from known edits or from their lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from annospark.functions.alignment import blocks
from annospark.functions.binding import let, settled
from annospark.functions.cached import per_context
from annospark.operators import merge


def row_diff(
    before: DataFrame, after: DataFrame, key: str | Sequence[str], value: str
) -> DataFrame:
    """Keys that were added, removed or changed, with ``before`` and ``after`` values."""
    on = [key] if isinstance(key, str) else list(key)
    old = before.select(*on, F.col(value).alias("before"), F.lit(True).alias("_old"))
    new = after.select(*on, F.col(value).alias("after"), F.lit(True).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    )
    return (
        old.join(new, on, "full_outer")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(*on, "change", "before", "after")
    )


def keyless_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows only in one version, counted as a multiset: ``sign`` is ``-`` or ``+``.

    Both versions are counted map-side in one aggregate, so a row that makes up a
    third of the data moves as one partial count per task.
    """
    columns = before.columns
    both = before.select(*columns, F.lit(-1).alias("_n")).unionByName(
        after.select(*columns, F.lit(1).alias("_n"))
    )
    net = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    return net.select(
        *columns,
        F.when(F.col("_n") < 0, "-").otherwise("+").alias("sign"),
        F.abs("_n").alias("copies"),
    )


def _ops(lines: Column, edit_list: Column) -> Column:
    """Edits with removed and inserted lines; lines they share at either end dropped."""

    def one(e: Column) -> Column:
        old = F.slice(lines, e["after"] + 1, e["upto"] - e["after"])
        new = F.split(e["text"], "\n")
        return F.struct(e["after"].alias("after"), old.alias("old"), new.alias("new"), e["shift"].alias("shift"))

    def same_head(a: Column, b: Column) -> Column:
        differs = F.filter(
            F.transform(a, lambda x, i: F.when(~x.eqNullSafe(F.get(b, i)), i)),
            lambda i: i.isNotNull(),
        )
        return F.coalesce(F.get(differs, F.lit(0)), F.least(F.size(a), F.size(b)))

    def trim_head(o: Column) -> Column:
        n = same_head(o["old"], o["new"])
        return F.struct(
            (o["after"] + n).alias("after"),
            F.slice(o["old"], n + 1, F.size(o["old"]) - n).alias("old"),
            F.slice(o["new"], n + 1, F.size(o["new"]) - n).alias("new"),
            o["shift"].alias("shift"),
        )

    def trim_tail(o: Column) -> Column:
        n = same_head(F.reverse(o["old"]), F.reverse(o["new"]))
        return F.struct(
            o["after"].alias("after"),
            F.slice(o["old"], F.lit(1), F.size(o["old"]) - n).alias("old"),
            F.slice(o["new"], F.lit(1), F.size(o["new"]) - n).alias("new"),
            o["shift"].alias("shift"),
        )

    trimmed = F.transform(F.transform(F.transform(edit_list, one), trim_head), trim_tail)
    return F.filter(trimmed, lambda o: (F.size(o["old"]) > 0) | (F.size(o["new"]) > 0))


@per_context
def _found_ops() -> Column:
    return let(F.col("lines"), lambda lines: _ops(lines, F.col("edits")))


def _by_file(edit_rows: DataFrame) -> DataFrame:
    """The changing edits of a file in line order, each with the lines by which earlier ones move it.

    The running sum and the list share one partitioning by path; what a row holds of an
    edit's lines is trimmed later by as many old as new ones, so the sum stays right.
    """
    grown = F.size(F.split("text", "\n")) - (F.col("upto") - F.col("after"))
    earlier = Window.partitionBy("path").orderBy("after").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(grown).over(earlier), F.lit(0)).cast("int")
    edit = F.struct("after", "upto", "text", "shift")
    rows = edit_rows.where(F.col("text").isNotNull()).withColumn("shift", shift)
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(edit)).alias("edits"))


def edited(files: DataFrame, edit_rows: DataFrame) -> DataFrame:
    """Files that edits change: ``path, lines, ops``.

    An op puts lines ``new`` in place of lines ``old`` that stand after line ``after``; ``shift`` is
    how far earlier ops move it.
    """
    joined = files.join(_by_file(edit_rows), "path")
    split = joined.select("path", merge.source_lines(F.col("source")).alias("lines"), "edits")
    ops = settled(split.select("path", "lines", _found_ops().alias("ops")), "lines", "ops")
    # A line array that ends in "" stands for a text with a final line end.
    ended = F.element_at("lines", -1) == ""
    body = F.when(ended, F.slice("lines", F.lit(1), F.size("lines") - 1)).otherwise(F.col("lines"))
    return ops.where(F.size("ops") > 0).select("path", body.alias("lines"), "ops")


#: What stands below a last line without a line end, as in other diff tools.
UNENDED = "\n\\ No newline at end of file"


@per_context
def _lines_of(text: str) -> Column:
    """Lines of a text; the last one is marked where it has no line end.  Null has none."""
    def marked(lines: Column) -> Column:
        last = F.element_at(lines, -1)
        head = F.slice(lines, F.lit(1), F.size(lines) - 1)
        return F.when(last == "", head).otherwise(F.concat(head, F.array(F.concat(last, F.lit(UNENDED)))))

    return F.coalesce(let(merge.source_lines(F.col(text)), marked), F.array().cast("array<string>"))


def compared(before: DataFrame, after: DataFrame, key: str = "path", value: str = "source") -> DataFrame:
    """What differs between two versions of a table of texts: ``path, lines, ops`` as ``edited`` gives.

    Lines that are as frequent in both texts, the rarest first, align them where they keep their
    order; what lies between is aligned in the same way until no common line is left.  Texts meet
    by key; those that are equal go before a line is cut.  Only hashes of lines leave the JVM.  A
    text that is null or in one version only has no lines in the other.
    """
    old = before.select(F.col(key).alias("path"), F.col(value).alias("_old"))
    new = after.select(F.col(key).alias("path"), F.col(value).alias("_new"))
    both = old.join(new, "path", "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    cut = settled(both.select("path", _lines_of("_old").alias("lines"), _lines_of("_new").alias("_lines")), "lines", "_lines")
    hashed = [F.transform(c, lambda l: F.xxhash64(l)) for c in ("lines", "_lines")]
    found = cut.withColumn("_found", blocks(*hashed))

    def op(b: Column) -> Column:
        return F.struct(
            b["after"].alias("after"),
            F.slice("lines", b["after"] + 1, b["upto"] - b["after"]).alias("old"),
            F.slice("_lines", b["start"] + 1, b["end"] - b["start"]).alias("new"),
            (b["start"] - b["after"]).alias("shift"),
        )

    at = F.sequence(F.lit(0), (F.size("_found") / 4 - 1).cast("int"))
    quads = F.transform(at, lambda i: F.struct(*[
        F.get("_found", i * 4 + k).alias(name) for k, name in enumerate(("after", "upto", "start", "end"))]))
    ops = F.when(F.size("_found") > 0, F.transform(quads, op))
    return found.select("path", "lines", ops.alias("ops")).where(F.size("ops") > 0)


def line_diff(files: DataFrame, edit_rows: DataFrame) -> DataFrame:
    """``path, line, part, sign, text``: every line of the files that edits change.

    ``line`` counts in the old text; inserted lines follow it by ``part``.
    """
    return line_rows(edited(files, edit_rows))


def line_rows(changed: DataFrame) -> DataFrame:
    """The rows of ``line_diff`` for what ``edited`` or ``compared`` gives."""
    starts = F.concat(
        F.array(F.lit(0)), F.transform("ops", lambda o: o["after"] + F.size(o["old"]))
    )

    def rows(texts: Column, first: Column, sign: str) -> Column:
        return F.transform(
            texts,
            lambda t, i: F.struct(
                (first if sign == "+" else first + i + 1).alias("line"),
                (i + 1 if sign == "+" else F.lit(0)).alias("part"),
                F.lit(sign).alias("sign"),
                t.alias("text"),
            ),
        )

    def stretch(o: Column, i: Column) -> Column:
        start = F.get("starts", i)
        return F.concat(
            rows(F.slice("lines", start + 1, o["after"] - start), start, " "),
            rows(o["old"], o["after"], "-"),
            rows(o["new"], o["after"] + F.size(o["old"]), "+"),
        )

    done = F.element_at("starts", -1)
    tail = rows(F.slice("lines", done + 1, F.size("lines") - done), done, " ")
    return (
        changed.withColumn("starts", starts)
        .select("path", F.concat(F.flatten(F.transform("ops", stretch)), tail).alias("rows"))
        .select("path", F.explode_outer("rows").alias("d"))
        .select("path", "d.*")
    )


def unified(
    files: DataFrame, edit_rows: DataFrame, context: int = 3, lineterm: str = "\n"
) -> DataFrame:
    """Unified diff text per file that edits change: ``path, diff``.

    Edits closer than twice the context share a hunk.  ``lineterm`` ends the header
    lines; the empty string runs them into one line.
    """
    return unified_texts(edited(files, edit_rows), context, lineterm)


def unified_texts(changed: DataFrame, context: int = 3, lineterm: str = "\n") -> DataFrame:
    """``path, diff`` for what ``edited`` or ``compared`` gives."""
    return changed.select("path", _unified_text(context, lineterm).alias("diff"))


@per_context
def _unified_text(context: int, lineterm: str) -> Column:
    lines, ops = F.col("lines"), F.col("ops")

    def end_of(op: Column) -> Column:
        return op["after"] + F.size(op["old"])

    # Index of the first op of each hunk.
    begins = F.filter(
        F.transform(
            ops,
            lambda o, i: F.when(
                (i == 0) | (o["after"] - end_of(F.get(ops, i - 1)) > 2 * context), i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    def hunk(first: Column, beyond: Column) -> Column:
        mine = F.slice(ops, first + 1, beyond - first)
        start = F.greatest(F.get(ops, first)["after"] - context, F.lit(0))
        end = F.least(end_of(F.get(ops, beyond - 1)) + context, F.size(lines))
        shift = F.get(ops, first)["shift"]
        grown = F.aggregate(mine, F.lit(0), lambda n, o: n + F.size(o["new"]) - F.size(o["old"]))
        facts = F.struct(
            mine.alias("mine"),
            start.alias("start"),
            end.alias("end"),
            shift.alias("shift"),
            grown.alias("grown"),
            F.concat(F.array(start), F.transform(mine, end_of)).alias("starts"),
        )
        return let(facts, hunk_text)

    def span(start: Column, length: Column) -> Column:
        shown = F.when(length == 0, start).otherwise(start + 1).cast("string")
        return F.when(length == 1, shown).otherwise(
            F.concat(shown, F.lit(","), length.cast("string"))
        )

    def marked(sign: str, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.concat(F.lit(sign), t, F.lit("\n")))

    def kept(start: Column, end: Column) -> Column:
        return marked(" ", F.slice(lines, start + 1, end - start))

    def hunk_text(h: Column) -> Column:
        length = h["end"] - h["start"]
        head = F.concat(
            F.lit("@@ -"), span(h["start"], length),
            F.lit(" +"), span(h["start"] + h["shift"], length + h["grown"]),
            F.lit(" @@"), F.lit(lineterm),
        )
        body = F.flatten(
            F.transform(
                h["mine"],
                lambda o, i: F.concat(
                    kept(F.get(h["starts"], i), o["after"]),
                    marked("-", o["old"]),
                    marked("+", o["new"]),
                ),
            )
        )
        rest = kept(F.element_at(h["starts"], -1), h["end"])
        return F.concat(head, F.array_join(F.concat(body, rest), ""))

    texts = let(
        F.struct(begins.alias("begins")),
        lambda b: F.transform(
            b["begins"],
            lambda first, n: hunk(first, F.coalesce(F.get(b["begins"], n + 1), F.size(ops))),
        ),
    )
    path, end = F.col("path"), F.lit(lineterm)
    return F.concat(
        F.lit("--- a/"), path, end, F.lit("+++ b/"), path, end, F.array_join(texts, "")
    )
