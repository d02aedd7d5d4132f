"""Batch generation with a caller-given function, and its retry accounting."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from annospark import schemas
from annospark.sources.shared import shared_folder

# Waits in seconds, outcomes and what they mean for a retry.
OTHER_WAIT_S = 1.0
OK, RATE_LIMIT, AUTH, TIMEOUT, OTHER = "ok", "rate_limit", "auth", "timeout", "other"
FATAL = (AUTH, TIMEOUT)
RATE_LIMIT_CODES = (429,)
AUTH_CODES = (401, 403)
PROVIDERS = {
    "anthropic": {"needs_key": True, "base_url": None},
    "openai": {"needs_key": True, "base_url": None},
    "ollama": {"needs_key": False, "base_url": "http://localhost:11434"},
}


class GenerationError(Exception):
    """What a generator raises; ``kind`` is one of the outcomes above."""

    kind = OTHER

    def __init__(self, message: str, kind: str | None = None) -> None:
        super().__init__(message)
        if kind is not None:
            self.kind = kind


def attempts_of(
    call: Callable[[str], str], prompt: str, max_retries: int, sleep: Callable[[float], None]
) -> tuple[str | None, str, str | None, int, float]:
    waited = 0.0
    kind, message = OTHER, ""
    for attempt in range(max_retries):
        try:
            answer = call(prompt)
            if answer and answer.strip():
                return answer, OK, None, attempt + 1, waited
            kind, message = OTHER, "Empty response"
        except Exception as error:  # one record never stops the run
            kind, message = getattr(error, "kind", OTHER), str(error)
        if kind in FATAL:
            return None, kind, message, attempt + 1, waited
        if attempt + 1 < max_retries:
            pause = float(2**attempt) if kind == RATE_LIMIT else OTHER_WAIT_S
            sleep(pause)
            waited += pause
    reason = "Rate limit exceeded" if kind == RATE_LIMIT else "Failed"
    return None, kind, f"{reason} after {max_retries} attempts: {message}", max_retries, waited


#: Prompts a task answers before another client is worth while.
PROMPTS_PER_TASK = 100


def generate(
    prompts: DataFrame,
    make_client: Callable[[], Callable[[str], str]],
    max_retries: int = 3,
    tasks: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Adds ``answer, status, error, attempts, wait_s`` to prompt rows.

    ``make_client`` is called once per task and returns a function from prompt to
    text.  ``tasks`` is the number of clients at work; by default one for each
    ``PROMPTS_PER_TASK`` prompts, up to four for each core of the cluster, as a call costs the same
    whatever the size of its row.  Rows are dealt round-robin, so no key can pile up in one task.
    Filter before calling: nothing is pushed through a Python stage.  A lost task repeats its
    calls; ``chunks.answer_all`` keeps answers as they come.
    """
    schema = T.StructType(prompts.schema.fields + schemas.GENERATION_FIELDS)
    columns = [f.name for f in schemas.GENERATION_FIELDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            out = [attempts_of(client, p, max_retries, sleep) for p in batch["prompt"]]
            done = pd.DataFrame(out, columns=columns, index=batch.index)
            yield pd.concat([batch, done.astype({"attempts": "int32"})], axis=1)

    if not tasks:
        most = 4 * prompts.sparkSession.sparkContext.defaultParallelism
        tasks = min(most, -(-max(1, prompts.count()) // PROMPTS_PER_TASK))
    rows = prompts.repartition(tasks)
    return rows.mapInPandas(run, schema)


def pending(prompts: DataFrame, generations: DataFrame) -> DataFrame:
    """Prompts without a successful generation, by prompt hash."""
    done = generations.where(F.col("status") == OK).select("prompt_key").distinct()
    return prompts.join(done, "prompt_key", "left_anti")


def classify_error(code: Column, kind: Column) -> Column:
    """``struct(class, retryable)`` from a status code and an error kind."""
    name = (
        F.when(code.isin(*RATE_LIMIT_CODES), RATE_LIMIT)
        .when(code.isin(*AUTH_CODES), AUTH)
        .when(kind == TIMEOUT, TIMEOUT)
        .otherwise(OTHER)
    )
    return F.struct(name.alias("class"), (~name.isin(*FATAL)).alias("retryable"))


def is_empty_answer(answer: Column) -> Column:
    return F.coalesce(F.regexp_replace(answer, r"(?U)\s", ""), F.lit("")) == ""


def retry_outcomes(
    attempts: DataFrame, key: str | Sequence[str], max_retries: int = 3
) -> DataFrame:
    """How each key of an attempt log ``(key, attempt, outcome)`` ends.

    Attempts run from 0; the first ``ok``, fatal or last allowed one is final.  Per
    key: ``attempts`` made, ``status`` of the final one, ``wait_s`` spent between.
    Two aggregates that combine map-side; rows of a key are never gathered.
    """
    on = [key] if isinstance(key, str) else list(key)
    tried = attempts.where(F.col("attempt") < max_retries)
    stop = F.col("outcome").isin(OK, *FATAL) | (F.col("attempt") == max_retries - 1)
    waits = F.when(F.col("outcome") == RATE_LIMIT, F.pow(F.lit(2.0), "attempt")).otherwise(OTHER_WAIT_S)
    # At most max_retries distinct attempts per key, so the map stays that small.
    per_attempt = tried.groupBy(*on, "attempt").agg(
        F.max("outcome").alias("outcome"), F.bool_or(stop).alias("stop")
    )
    summed = per_attempt.groupBy(*on).agg(
        F.min(F.when(F.col("stop"), F.col("attempt"))).alias("final"),
        F.max("attempt").alias("last"),
        F.collect_list(F.struct("attempt", "outcome", waits.alias("wait"))).alias("log"),
    )
    end = F.coalesce("final", "last")
    status = F.filter("log", lambda r: r["attempt"] == end)[0]["outcome"]
    wait = F.aggregate(
        F.filter("log", lambda r: r["attempt"] < end), F.lit(0.0), lambda acc, r: acc + r["wait"]
    )
    return summed.select(
        *on, (end + 1).cast("int").alias("attempts"), status.alias("status"), wait.alias("wait_s")
    )


def route(
    prompts: DataFrame,
    settings: DataFrame,
    project: str = "project",
    default_provider: str = "anthropic",
) -> DataFrame:
    """Adds ``provider, model, base_url, needs_key, error`` from the project's settings.

    A key-bound provider without ``has_key`` in the settings, or an unknown one, is
    an error on the row.
    """
    own = settings.select(project, "provider", "model", "base_url", "has_key")
    # A table of known size: while it is small it is sent to the prompts, which else meet by project, few tasks for all.
    known = shared_folder(prompts.sparkSession, "settings")
    own.write.parquet(known)
    own = prompts.sparkSession.read.schema(own.schema).parquet(known)
    chosen = prompts.join(own, project, "left").withColumn("provider", F.coalesce("provider", F.lit(default_provider)))
    needs_key = F.when(F.lit(False), F.lit(None).cast("boolean"))
    base_url = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, facts in PROVIDERS.items():
        needs_key = needs_key.when(F.col("provider") == name, F.lit(facts["needs_key"]))
        base_url = base_url.when(F.col("provider") == name, F.lit(facts["base_url"]).cast("string"))
    return (
        chosen.withColumn("base_url", F.regexp_replace(F.coalesce("base_url", base_url), "/+$", ""))
        .withColumn("needs_key", needs_key)
        .withColumn(
            "error",
            F.when(F.col("needs_key").isNull(), F.concat(F.lit("Unsupported provider: "), "provider"))
            .when(F.col("needs_key") & ~F.coalesce("has_key", F.lit(False)),
                  F.concat("provider", F.lit(" API key is required"))),
        )
        .drop("has_key")
    )
