import os
import subprocess
import sys
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from annospark.operators import chunks, generate, prompts, runs, settings


def scripted(outcomes, calls):
    """Client that plays a list of outcomes per prompt, by attempt."""

    def make():
        seen = {}

        def call(prompt):
            n = seen[prompt] = seen.get(prompt, -1) + 1
            kind = outcomes[prompt][n]
            if kind == "ok":
                return "answer"
            if kind == "empty":
                return "  "
            raise generate.GenerationError("no", kind)

        return call

    return make


LOGS = {
    "first": ["ok"],
    "after limits": ["rate_limit", "rate_limit", "ok"],
    "auth": ["auth", "ok"],
    "timeout": ["other", "timeout", "ok"],
    "gives up": ["rate_limit", "rate_limit", "rate_limit", "rate_limit", "ok"],
    "others": ["other", "empty", "other", "other"],
    "last": ["other", "rate_limit", "other", "ok"],
}
WANT = {
    "first": ("ok", 1, 0.0), "after limits": ("ok", 3, 3.0), "auth": ("auth", 1, 0.0),
    "timeout": ("timeout", 2, 1.0), "gives up": ("rate_limit", 4, 7.0),
    "others": ("other", 4, 3.0), "last": ("ok", 4, 4.0),
}


def no_sleep(seconds):
    pass


def test_generate_retries(spark):
    df = spark.createDataFrame([(p,) for p in LOGS], "prompt string")
    out = generate.generate(df, scripted(LOGS, {}), max_retries=4, tasks=2, sleep=no_sleep).collect()
    assert {r.prompt: (r.status, r.attempts, r.wait_s) for r in out} == WANT
    by = {r.prompt: r for r in out}
    assert by["first"].answer == "answer" and by["first"].error is None
    assert by["gives up"].error == "Rate limit exceeded after 4 attempts: no"


def test_retry_outcomes_of_the_same_log(spark):
    rows = [(k, i, "other" if o == "empty" else o) for k, log in LOGS.items() for i, o in enumerate(log)]
    log = spark.createDataFrame(rows, "key string, attempt int, outcome string")
    out = generate.retry_outcomes(log, "key", 4).collect()
    assert {r.key: (r.status, r.attempts, r.wait_s) for r in out} == WANT


@pytest.mark.parametrize("limits", range(5))
def test_back_off_sums_to_powers_of_two(spark, limits):
    rows = [("k", i, "rate_limit") for i in range(limits)] + [("k", limits, "ok")]
    log = spark.createDataFrame(rows, "key string, attempt int, outcome string")
    row = generate.retry_outcomes(log, "key", 5).first()
    assert (row.status, row.attempts, row.wait_s) == ("ok", limits + 1, 2.0**limits - 1)


def test_error_classes(spark):
    rows = [(429, "http"), (401, "http"), (403, "http"), (None, "timeout"), (500, "http"), (None, "other")]
    df = spark.createDataFrame(rows, "code int, kind string")
    got = [tuple(r.c) for r in df.select(generate.classify_error(F.col("code"), F.col("kind")).alias("c")).collect()]
    assert got == [("rate_limit", True), ("auth", False), ("auth", False), ("timeout", False), ("other", True), ("other", True)]


def test_filters_stay_below_generation(spark):
    df = spark.createDataFrame([("a", True), ("b", False)], "prompt string, has_docstring boolean")
    plan = generate.generate(df.where(~F.col("has_docstring")), scripted(LOGS, {}))._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    assert text.index("MapInPandas") < text.index("Filter")


def test_prompt_contents(spark):
    schema = "name string, params array<struct<name:string,type_hint:string>>, return_type string, body_preview string, existing_docstring string"
    rows = [
        ("add", [("a", "int"), ("*rest", None)], "int", "return a", None),
        ("old", [], None, "", "Has one."),
        ("empty", [], None, "{style}", ""),
    ]
    out = {r.name: r.prompt for r in prompts.prompts(spark.createDataFrame(rows, schema), "google").collect()}
    assert "def add(a: int, *rest) -> int:" in out["add"] and "Google" in out["add"] and "return a" in out["add"]
    assert "neither quotes nor fences" in out["add"] and "so far" not in out["add"]
    assert "Has one." in out["old"] and "def old():" in out["old"]
    assert "so far" not in out["empty"] and "\n{style}\n" in out["empty"]


def test_cost_of_documented_project_sizes(spark):
    prices = {"a": (3.0, 15.0), "free": (0.0, 0.0)}
    out = {r.model: r for r in prompts.cost(spark.range(1000), prices).collect()}
    assert out["a"].tokens_in + out["a"].tokens_out == 600_000
    assert out["a"].usd == pytest.approx(4.2) and out["free"].usd == 0


def test_settings_layers(spark):
    rows = [("p", "style", "file", "numpy"), ("p", "style", "env", "sphinx"), ("p", "style", "arg", None),
            ("p", "timeout", "file", "999"), ("q", "exclude", "file", '["a","b"]'), ("q", "model", "unknown", "x")]
    given = spark.createDataFrame(rows, "project string, key string, layer string, value string")
    projects = spark.createDataFrame([("p",), ("q",)], "project string")
    got = {r.project: r for r in settings.violations(settings.resolve(given.unionByName(settings.default_rows(projects)))).collect()}
    assert (got["p"].style, got["q"].style, got["q"].model) == ("sphinx", "google", settings.DEFAULTS["model"])
    assert got["p"].violations == ["timeout: 999 is not in 5..300"] and got["q"].violations == []
    listed = settings.resolve(given).where("project = 'q'").select(settings.exclude_patterns(F.col("exclude")).alias("x"))
    assert listed.first().x == ["a", "b"]


def test_error_lines_round_trip(spark):
    rows = [("a.py", 3, "LLM error", "x - y"), ("b.py", None, "Parse error", "bad")]
    df = spark.createDataFrame(rows, "path string, line int, stage string, message string")
    lines = runs.error_lines(df)
    assert [r.value for r in lines.collect()] == ["a.py:3 - LLM error: x - y", "b.py - Parse error: bad"]
    got = lines.select(runs.split_error(F.col("value")).alias("e")).select("e.*").collect()
    assert [(r.location, r.message) for r in got] == [("a.py:3", "LLM error: x - y"), ("b.py", "Parse error: bad")]
    odd = spark.createDataFrame([("no separator",)], "t string").select(runs.split_error(F.col("t")).alias("e"))
    assert tuple(odd.first().e) == ("", "no separator")


def keyed(spark, prompts_):
    df = spark.createDataFrame([(p,) for p in prompts_], "prompt string")
    return df.withColumn("prompt_key", F.sha2("prompt", 256))


def logging_client(log, fails=()):
    def make(**route):
        def call(prompt):
            with open(log, "a") as handle:
                handle.write(f"{route.get('provider')} {prompt}\n")
            if prompt in fails:
                raise generate.GenerationError("no", generate.AUTH)
            return "to " + prompt

        return call

    return make


def test_chunks_have_the_size_asked_for(spark, tmp_path):
    log, path = str(tmp_path / "calls"), str(tmp_path / "answers")
    df = keyed(spark, [f"p{i}" for i in range(103)] * 2)
    out = chunks.answer_all(df, logging_client(log, {"p7"}), path, batch_size=10, tasks=3, sleep=no_sleep)
    assert out.count() == 103 and sum(1 for _ in open(log)) == 103
    sizes = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) == 10 and sum(n < 10 for n in sizes) <= 3
    again = chunks.answer_all(df, logging_client(log), path, batch_size=10, tasks=3, sleep=no_sleep)
    assert sum(1 for _ in open(log)) == 104 and again.count() == 104  # the failed one is asked again
    good = {r.prompt_key: r.status for r in chunks.best(again).collect()}
    assert len(good) == 103 and set(good.values()) == {"ok"}
    with pytest.raises(ValueError):
        chunks.answer_all(df, logging_client(log), path, batch_size=0)


def test_rows_keep_their_order_in_chunks_of_any_size():
    batches = [pd.DataFrame({"x": range(a, b)}) for a, b in ((0, 7), (7, 7), (7, 8), (8, 30))]
    for size in (1, 3, 7, 8, 100):
        parts = [list(c["x"]) for c in chunks._dealt(iter(batches), size)]
        assert sum(parts, []) == list(range(30)) and all(len(p) == size for p in parts[:-1])


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from annospark.operators import chunks
spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {folder!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

def make():
    from pyspark import TaskContext
    context = TaskContext.get()
    made = []
    def call(prompt):
        if context.attemptNumber() == 0 and len(made) == 35:  # three chunks of ten are kept by now
            os._exit(1)
        made.append(prompt)
        with open({log!r}, "a") as handle:
            handle.write(prompt + chr(10))
        return "to " + prompt
    return call

df = spark.range(120).select(F.concat(F.lit("p"), "id").alias("prompt")).withColumn("prompt_key", F.sha2("prompt", 256))
out = chunks.answer_all(df, make, {path!r}, batch_size=10, tasks=2)
assert out.count() == 120 and out.select("prompt_key").distinct().count() == 120
"""


def test_a_killed_task_pays_for_no_kept_chunk_twice(tmp_path):
    log, path = str(tmp_path / "calls"), str(tmp_path / "answers")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = KILLED.format(root=root, folder=str(tmp_path / "shared"), log=log, path=path)
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=root)
    calls = Counter(line.strip() for line in open(log))
    assert len(calls) == 120 and set(calls.values()) == {1, 2}
    twice = [p for p, n in calls.items() if n == 2]
    assert len(twice) == 10  # the open chunk's first five calls, in each of the two tasks


class Clock:
    """A clock that only sleeping moves."""

    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_routes_errors_and_rates(spark, tmp_path):
    log, path = str(tmp_path / "calls"), str(tmp_path / "answers")
    given = [(f"p{i}", f"pr{i % 4}") for i in range(80)]
    df = spark.createDataFrame(given, "prompt string, project string").withColumn("prompt_key", F.sha2("prompt", 256))
    chosen = spark.createDataFrame(
        [("pr0", "ollama", "m", None, False), ("pr1", "openai", "n", None, True), ("pr2", "openai", "n", None, False), ("pr3", "odd", None, None, True)],
        "project string, provider string, model string, base_url string, has_key boolean",
    )
    clock = Clock()

    def make(provider, model, base_url):
        def call(prompt):
            with open(log, "a") as handle:
                handle.write(f"{provider} {clock()} {os.getpid()}\n")
            return f"{provider} {model} {base_url}"

        return call

    routed = generate.route(df, chosen)
    out = chunks.answer_all(routed, make, path, batch_size=7, tasks=2, sleep=clock.sleep, clock=clock,
                            route=("provider", "model", "base_url"), rates={"openai": 4.0})
    got = {r.prompt: r for r in out.join(df, "prompt_key").collect()}
    assert len(got) == 80
    assert got["p0"].answer == "ollama m http://localhost:11434" and got["p1"].answer == "openai n None"
    assert (got["p2"].status, got["p2"].error, got["p2"].attempts) == ("auth", "openai API key is required", 0)
    assert (got["p3"].status, got["p3"].error) == ("other", "Unsupported provider: odd")
    calls = [line.split() for line in open(log)]
    assert Counter(c[0] for c in calls) == {"ollama": 20, "openai": 20}
    # each of the two tasks has a clock of its own and half the rate: two calls a second
    times = defaultdict(list)
    for provider, at, pid in calls:
        if provider == "openai":
            times[pid].append(float(at))
    for at in times.values():
        at = sorted(at)
        starts = [i for i, t in enumerate(at) if i == 0 or t == 0]
        for a, b in zip(at, at[1:]):
            assert b - a >= 0.5 or b == a == 0 and len(starts) > 1


def test_pace_holds_calls_apart():
    clock = Clock()
    pace = chunks.Pace(0.25, clock, clock.sleep)
    seen = []
    for work in [0.0, 0.0, 1.0, 0.1, 0.0]:
        pace.wait()
        seen.append(clock.now)
        clock.now += work
    assert seen == [0.0, 0.25, 0.5, 1.5, 1.75]


def test_prompts_do_not_pile_up_by_project(spark):
    """Settings of unknown size, made from the prompts: these are not dealt by project, of which there are two."""
    rows = spark.range(3_000_000).select("id", (F.col("id") % 2).cast("string").alias("project"), F.lit("text").alias("prompt"))
    made = rows.select("project").distinct().select(
        "project", F.lit("openai").alias("provider"), F.lit("m").alias("model"), F.lit("http://x/").alias("base_url"),
        (F.col("project") == "1").alias("has_key"))
    routed = generate.route(rows, made)
    assert "hashpartitioning(project" not in routed._jdf.queryExecution().executedPlan().toString()
    counts = {(r.base_url, r.error): r["count"] for r in routed.groupBy("base_url", "error").count().collect()}
    assert counts == {("http://x", None): 1_500_000, ("http://x", "openai API key is required"): 1_500_000}
