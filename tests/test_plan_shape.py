"""Plans that have to keep their shape for scale."""

import __spark_entry__ as entry
from annospark.operators import coverage, merge, scan

SF = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registered_plans_have_no_cross_join(spark):
    for name in ("a8_annotation_coverage", "p5_cost", "f6_rules_by_scope", "g5_route", "m1_merge", "d1_row_diff"):
        text = executed(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_report_is_one_exchange_of_partial_counts(files):
    text = executed(coverage.report(files("def f(): pass\n")))
    assert text.count("Exchange") == 1 and "Window" not in text and "partial_count_if" in text.replace(
        "partial_count(", "partial_count_if("
    )


def test_retry_log_is_cut_before_the_shuffle(spark):
    text = executed(entry.queries()["g2_retry_outcomes"](spark, SF))
    assert text.count("WindowGroupLimit") == 2


def test_only_needed_columns_are_read(spark):
    text = executed(entry.queries()["a8_annotation_coverage"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in text
    assert "ReadSchema: struct<doc_id:bigint>" in text


def test_unused_record_columns_are_pruned(files):
    text = executed(scan.functions(files("def f(): pass\n")).select("path", "has_docstring"))
    assert text.count(scan.lx.GROUP) == 1  # veiling brackets only, no parameter lists


def test_unchanged_files_are_not_rebuilt_by_key(spark, files):
    df = files("def f():\n    pass\n")
    new = scan.functions(df).selectExpr("path", "line_number", "'New.' AS docstring")
    edits = merge.edits(merge.targets(scan.function_sites(df), new))
    assert "CartesianProduct" not in executed(merge.inject(df, new))
    assert merge.apply_edits(df, edits).count() == 1
