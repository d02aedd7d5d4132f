import json
import os
import random
import textwrap

from pyspark.sql import functions as F

from annospark.operators import coverage, generate, rules, scan
from annospark.plans.annotate import annotate
from annospark.plans.report import coverage_report
from annospark.sources import changes, corpus as corpora
from annospark.streaming import incremental

SAMPLE = textwrap.dedent('''
    def greet(name: str) -> str:
        """Say hello."""
        return f"Hello, {name}"

    def add(a, b):
        return a + b

    class Calculator:
        """A calculator."""

        def __init__(self):
            self.value = 0

        def add(self, x):
            return x

        def reset(self):
            self.value = 0
''')


def totals(df):
    r = df.first()
    return (r.total, r.documented, round(r.coverage_pct, 6))


def test_coverage_arithmetic(files):
    assert totals(coverage.report(files(SAMPLE))) == (5, 1, 20.0)
    assert totals(coverage.report(files(""))) == (0, 0, 0.0)
    row = coverage.report(files(SAMPLE, "def broken(\n", "class A:\n    '''Doc.'''\n")).first()
    assert (row.total, row.documented, row.skipped_files) == (5, 1, 1)
    gaps = coverage.missing(scan.functions(files(SAMPLE)))
    assert sorted(r.line for r in gaps.collect()) == [6, 12, 15, 18]


def test_gates(files):
    df = coverage.report(files(SAMPLE))
    assert coverage.gate(df, min_pct=20).first().passed
    assert not coverage.gate(df, min_pct=20.1).first().passed
    row = coverage.gate(df, require_all=True).first()
    assert (row.passed, row.missing) == (False, 4)
    assert coverage_report(files("x = 1\n"), require_all=True).first().passed


def test_json_and_log_lines(files):
    records = scan.functions(files(SAMPLE))
    doc = json.loads(coverage.report_json(coverage.report(files(SAMPLE))).first().value)
    assert doc == {"total_functions": 5, "documented_functions": 1, "coverage_percentage": 20.0}
    doc = json.loads(coverage.file_report_json(records).first().value)
    assert [m["line"] for m in doc["missing_docstrings"]] == [6, 12, 15, 18]
    lines = sorted(r.value for r in coverage.annotations(coverage.missing(records)).collect())
    assert lines[0] == "::warning file=f0.py,line=12::Missing docstring"
    top = {r["rank"]: r.text for r in coverage.missing_top(coverage.missing(records), 3).collect()}
    assert top == {1: "- `f0.py:6`", 2: "- `f0.py:12`", 3: "- `f0.py:15`", 4: "... and 1 more"}


def counting_client(log):
    def make():
        def call(prompt):
            with open(log, "a") as handle:
                handle.write("x\n")
            if "def reset" in prompt:
                raise generate.GenerationError("denied", generate.AUTH)
            return "```python\n\"\"\"Generated.\n\nArgs:\n    x: value\n\"\"\"\n```"

        return call

    return make


def test_annotate_resume_and_dry_run(spark, files, tmp_path):
    df = files(SAMPLE, "def broken(\n")
    log, answers = str(tmp_path / "calls"), str(tmp_path / "answers")
    run = annotate(df, counting_client(log), only_missing=True, generations_path=answers, sleep=lambda s: None)
    row = run.stats.first()
    assert (row.files_processed, row.added, row.updated, row.errors) == (1, 3, 0, 2)
    errors = sorted((r.path, r.line, r.stage) for r in run.errors.collect())
    assert errors == [("f0.py", 18, "LLM error"), ("f1.py", None, "Parse error")]
    done = {r.path: r.source for r in run.corpus.collect()}
    assert done["f1.py"] == "def broken(\n" and done["f0.py"].count('"""Generated.') == 3
    assert sum(1 for _ in open(log)) == 4

    again = annotate(df, counting_client(log), only_missing=True, generations_path=answers, sleep=lambda s: None)
    assert again.stats.first().added == 3
    assert sum(1 for _ in open(log)) == 5  # only the failed one is asked again

    dry = annotate(df, counting_client(log), generations_path=answers, sleep=lambda s: None, dry_run=True)
    assert {r.path: r.source for r in dry.corpus.collect()} == {"f0.py": SAMPLE, "f1.py": "def broken(\n"}
    text = dry.preview(df).first()["diff"]
    assert text.startswith("--- a/f0.py\n+++ b/f0.py\n@@") and '-    """Say hello."""' in text
    row = dry.stats.first()
    assert (row.added, row.updated) == (0, 0)


def test_annotate_looks_only_at_chosen_files(spark, tmp_path):
    body = "def f(a):\n    return a\n"
    rows = [(p, body) for p in ("src/a.py", "src/b.py", "src/c.txt", "lib/a.py", "lib/test_b.py", ".hid/a.py")]
    df = spark.createDataFrame(rows, "path string, source string")
    log = spark.createDataFrame([(p, "M", 1) for p, _ in rows if p != "src/b.py"], "path string, status string, ts int")
    chosen = spark.createDataFrame([("src", "sphinx", "ollama", "small"), ("lib", None, "openai", "large")],
                                   "project string, style string, provider string, model string")

    def make(provider, model, base_url):
        return lambda prompt: f"{provider} {model} {'Sphinx' in prompt}."

    run = annotate(df, make, exclude=["test_*"], changes=log, settings=chosen, only_missing=True, batch_size=1)
    got = {r.path: r.source for r in run.corpus.collect()}
    new = {"src/a.py": "ollama small True.", "lib/a.py": "openai large False."}
    assert got == {p: body.replace("    ret", f'    """{new[p]}"""\n    ret') if p in new else body for p, _ in rows}
    assert tuple(run.stats.first()) == (2, 2, 0, 0)
    keyless = annotate(df, make, settings=chosen.withColumn("has_key", F.lit(False)), extensions=[".py"])
    assert sorted((r.path, r.message) for r in keyless.errors.collect()) == [
        ("lib/a.py", "openai API key is required"), ("lib/test_b.py", "openai API key is required")]


def test_counters_read_little(spark, files):
    run = annotate(files(SAMPLE), lambda: lambda prompt: "Text.")
    plan = run.stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4 and plan.count("Join") <= 1 and plan.count("FileScan") <= 2


def test_ingest_tree(spark, tmp_path):
    for name, body in {
        "a.py": b"x = 1\n", "pkg/__init__.py": b"", "pkg/.dot.py": b"y = 1\n", "_private/b.py": b"\xff\xfe",
        ".git/c.py": b"no", "pkg/.hid/d.py": b"no", "odd/a b#1%20.py": b"z = 1\n", "pkg/deep/er/e.py": "é = 1\n".encode(), "f.txt": b"no",
    }.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    got = {os.path.relpath(r.path, tmp_path): r.source for r in corpora.ingest_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x = 1\n", "pkg/__init__.py": "", "pkg/.dot.py": "y = 1\n", "_private/b.py": None,
                   "pkg/deep/er/e.py": "é = 1\n", "odd/a b#1%20.py": "z = 1\n"}
    assert corpora.ingest_tree(spark, str(tmp_path / "a.py")).count() == 1
    assert corpora.ingest_tree(spark, str(tmp_path / "f.txt")).count() == 0
    assert corpora.ingest_tree(spark, str(tmp_path / "absent")).count() == 0
    both = corpora.ingest_tree(spark, str(tmp_path), [".py", ".txt"])
    assert both.count() == 7
    row = coverage.report(corpora.ingest_tree(spark, str(tmp_path))).first()
    assert row.skipped_files == 1


def test_excluded_folders_are_never_listed(spark, tmp_path):
    for name in ("src/a.py", "src/b_test.py", "src/deep/c.py", "build/x/y/d.py", "node/e.py", "node/keep/f.py", ".hid/g.py", "lib/build/h.py"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# made\n\nbuild/\n*_test.py\n")
    (tmp_path / "src" / ".gitignore").write_text("a.py\n")  # only the root's counts
    found = corpora.ingest_tree(spark, str(tmp_path), exclude=["/node/*", "!/node/keep"], ignore_file=".gitignore")
    assert sorted(os.path.relpath(r.path, tmp_path) for r in found.collect()) == ["node/keep/f.py", "src/a.py", "src/deep/c.py"]
    seen = corpora.walked(spark, str(tmp_path), ["/node/*", "!/node/keep"], ["build/"])
    listed = {os.path.relpath(r.parent, tmp_path) for r in seen.select("parent").distinct().collect()}
    assert listed == {".", "src", "src/deep", "node", "node/keep", "lib"}
    alone = corpora.ingest_tree(spark, str(tmp_path / "build/x/y/d.py"), exclude=["*"], ignore_file=".gitignore")
    assert alone.count() == 1


def test_listing_agrees_with_rules_on_paths(spark, tmp_path):
    rng = random.Random(11)
    names = {"/".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) + f"/{rng.choice('xyz')}{i}.py" for i in range(60)}
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    for patterns in (["a/", "!a/b"], ["/a/*", "!/a/b"], ["b/**"], ["**/c", "!x*.py"], ["*", "!a", "!a/*.py"], ["a/b/", "x*"]):
        want = sorted(r.path for r in rules.apply_rules(paths, exclude=patterns).collect())
        got = corpora.list_tree(spark, str(tmp_path), [".py"], exclude=patterns).collect()
        assert sorted(os.path.relpath(r.path, tmp_path) for r in got) == want, patterns


def test_state_stays_small_over_many_batches(spark, tmp_path):
    schema = "path string, source string, deleted boolean"
    rng, latest = random.Random(12), {}
    state = str(tmp_path / "state")
    held = {}

    class Batches:  # what a stream would call, without its start-up for each of fifty batches
        def foreachBatch(self, take):
            held["take"] = take
            return self

        def __getattr__(self, name):
            return lambda *a, **k: self

    stream = type("Stream", (), {"writeStream": Batches()})()
    incremental.incremental_coverage(stream, state, str(tmp_path / "c"), compact=6)
    for n in range(50):
        rows = {f"f{rng.randrange(12)}.py": rng.choice(["def f(): pass\n", "def g():\n    'd'\n", "def bad(\n", None]) for _ in range(4)}
        df = spark.createDataFrame([(p, t, t is None) for p, t in rows.items()], schema).coalesce(1)
        held["take"](df, n)
        if n % 13 == 5:
            held["take"](df, n)  # a replay
        latest.update(rows)
    assert len(os.listdir(state)) <= 2 * 6 + 2 and len(os.listdir(f"{state}/base")) <= 2
    now = [(p, t) for p, t in latest.items() if t is not None]
    want = coverage.report(spark.createDataFrame(now, "path string, source string")).first()
    got = incremental.current_coverage(spark, state).first()
    assert (got.total, got.documented, got.skipped_files) == (want.total, want.documented, want.skipped_files)


def test_changed_only(spark, files):
    log = spark.createDataFrame(
        [("f0.py", "A", 1), ("f0.py", "D", 2), ("f1.py", "D", 1), ("f1.py", "M", 2), ("gone.py", "A", 1), ("f2.py", "R", 1)],
        "path string, status string, ts int",
    )
    got = changes.changed_only(files("a", "b", "c", "d"), log).collect()
    assert [r.path for r in got] == ["f1.py"]


def test_incremental_equals_batch(spark, tmp_path):
    schema = "path string, source string"
    inbox, state, checkpoint = (str(tmp_path / n) for n in ("inbox", "state", "checkpoint"))
    batches = [
        [("a.py", "def f(): pass\n"), ("b.py", "def g():\n    'd'\n")],
        [("a.py", "def f():\n    'd'\ndef h(): pass\n"), ("c.py", "def broken(\n")],
        [("c.py", "def ok():\n    'd'\n")],
    ]
    latest = {}
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        incremental.incremental_coverage(stream, state, checkpoint).awaitTermination()
        latest.update(dict(rows))
        want = coverage.report(spark.createDataFrame(list(latest.items()), schema)).first()
        got = incremental.current_coverage(spark, state).first()
        assert (got.total, got.documented, got.skipped_files, got.coverage_pct) == (
            want.total, want.documented, want.skipped_files, want.coverage_pct,
        )
    assert len([n for n in os.listdir(state) if n.startswith("batch=")]) == 3


def test_newest_row_per_path_in_one_batch(spark):
    rows = [("a.py", "def f(): pass\n", 1), ("a.py", "x = 1\n", 2), ("b.py", "def g(): pass\n", 1)]
    df = spark.createDataFrame(rows, "path string, source string, ts int")
    got = {r.path: r.total for r in incremental.file_counts(incremental.newest(df, "ts")).collect()}
    assert got == {"a.py": 0, "b.py": 1}


def test_removed_files_leave_coverage(spark, tmp_path):
    schema = "path string, source string, deleted boolean, ts int"
    inbox, state, checkpoint = (str(tmp_path / n) for n in ("inbox", "state", "checkpoint"))
    batches = [
        [("a.py", "def f(): pass\n", False, 1), ("b.py", "def g():\n    'd'\n", None, 1), ("b.py", "def h(): pass\n", None, 0)],
        [("a.py", None, True, 3), ("a.py", "def f(): pass\n", False, 2)],
    ]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        incremental.incremental_coverage(stream, state, checkpoint, order=("ts",)).awaitTermination()
        row = incremental.current_coverage(spark, state).first()
        seen.append((row.total, row.documented, row.skipped_files))
    assert seen == [(2, 1, 0), (1, 1, 0)]


def test_corpus_versions(spark, files, tmp_path):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    corpora.write_corpus(files("a", "b"), old)
    before = corpora.read_corpus(spark, old)
    corpora.write_corpus(corpora.new_version(before, files("z")), new)
    assert {r.path: r.source for r in corpora.read_corpus(spark, new).collect()} == {"f0.py": "z", "f1.py": "b"}


def test_skewed_records_stay_whole(spark):
    """A third of the rows under one key: all are counted."""
    docs = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"), F.lit("en").alias("lang")
    )
    marks = spark.createDataFrame([(0,), (0,), (1,)], "doc_id long")
    row = coverage.annotation_coverage(docs, marks, "doc_id").first()
    assert (row.total, row.documented) == (9000, 3001)


def test_a_large_file_is_held_once(tmp_path):
    """Its bytes go from one Arrow buffer to the stream, with no copy among Python's objects."""
    import tracemalloc

    import pyarrow as pa

    (tmp_path / "large").write_bytes(b"0123456789abcdef" * (40 << 16))
    (tmp_path / "small").write_bytes(b"few")
    (tmp_path / "empty").write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("small", "large", "empty")]
    tracemalloc.start()
    found = {}
    for batch in corpora._reader(str(tmp_path), "")(iter([pa.RecordBatch.from_arrays([pa.array(paths)], ["path"])])):
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            found[path] = len(content.as_buffer()) if content.as_buffer() else 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == dict(zip(paths, (3, 40 << 20, 0))) and peak < 16 << 20
