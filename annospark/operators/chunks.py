"""Answers that are kept chunk by chunk, so that a loss costs one chunk of calls.

A task deals its prompts, in order of their keys, into chunks.  Each chunk becomes one file,
named after the run and its keys and moved into place when all its answers are there.  A task
that is repeated finds the chunks its lost forerunner kept and asks only for the others;
a run that is repeated asks only for keys without a good answer in any file.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from annospark import schemas
from annospark.operators import generate
from annospark.sources.shared import shared_folder

#: Prompts of a chunk.
BATCH = 50
ANSWERS = T.StructType([T.StructField("prompt_key", T.StringType()), *schemas.GENERATION_FIELDS])
_FILE = pa.schema([
    ("prompt_key", pa.string()), ("answer", pa.string()), ("status", pa.string()), ("error", pa.string()),
    ("attempts", pa.int32()), ("wait_s", pa.float64()),
])
_DONE = "chunks long, kept long, calls long"


class Pace:
    """Holds calls back so that no two are closer than the interval."""

    def __init__(self, interval: float, clock: Callable[[], float], sleep: Callable[[float], None]) -> None:
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.next: float | None = None

    def wait(self) -> None:
        now = self.clock()
        if self.next is not None and now < self.next:
            self.sleep(self.next - now)
            now = max(self.clock(), self.next)
        self.next = now + self.interval


def _dealt(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The same rows, ``size`` at a time."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            part, batch = batch.iloc[: size - n], batch.iloc[size - n :]
            held.append(part)
            n += len(part)
            if n == size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """Answers committed below ``path``, none where it does not exist."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner, recursive=True)
    return spark.read.schema(ANSWERS).parquet(path)


def answer_all(
    prompts: DataFrame,
    make_client: Callable[..., Callable[[str], str]],
    path: str,
    batch_size: int = BATCH,
    max_retries: int = 3,
    tasks: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    route: Sequence[str] = (),
    rates: Mapping[str, float] | None = None,
    clock: Callable[[], float] = time.monotonic,
) -> DataFrame:
    """Asks for every ``prompt_key`` of ``prompts`` without a good answer below ``path``; all answers there.

    ``path`` is a folder that all executors and Arrow's file systems reach.  Equal keys are asked once.
    ``tasks`` bounds the clients at work; by default their number grows with the prompts up
    to four for each core of the cluster.

    With ``route``, columns such as those of ``generate.route``, a client is made per task and
    different route as ``make_client(**route)``, and a row with an ``error`` is not asked: the
    error becomes its answer's.  ``rates`` bounds calls per second for values of the
    first route column, retries included: each task takes its equal share, so their sum holds
    however many of them run.  Keep speculation off: two attempts at one chunk both call.
    """
    if batch_size < 1 or tasks is not None and tasks < 1:
        raise ValueError("batch_size and tasks must be at least 1")
    spark = prompts.sparkSession
    columns = ["prompt_key", "prompt", *route] + (["error"] if route else [])
    wanted = generate.pending(prompts.select(*columns), kept(spark, path)).dropDuplicates(["prompt_key"])
    # The list of work is a table: a repeated task has to get the same prompts.
    work = shared_folder(spark, "prompts")
    wanted.write.parquet(work)
    wanted = spark.read.schema(wanted.schema).parquet(work)
    if not tasks:
        most = 4 * spark.sparkContext.defaultParallelism
        tasks = min(most, -(-max(1, wanted.count()) // generate.PROMPTS_PER_TASK))
    run, shares = uuid.uuid4().hex, {k: r / tasks for k, r in (rates or {}).items()}

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs, parquet

        store, folder = fs.FileSystem.from_uri(path)
        clients: dict[tuple, Callable[[str], str]] = {}
        paces: dict[str, Pace] = {}

        def client_of(place: tuple) -> Callable[[str], str]:
            if place not in clients:
                call = make_client(**dict(zip(route, place)))
                share = shares.get(place[0]) if place else None
                if share:
                    pace = paces.setdefault(place[0], Pace(1.0 / share, clock, sleep))
                    call = _held_back(call, pace)
                clients[place] = call
            return clients[place]

        def answered(row) -> tuple:
            if route and isinstance(row.error, str):
                kind = generate.AUTH if "key" in row.error else generate.OTHER
                return (None, kind, row.error, 0, 0.0)
            place = tuple(v if isinstance(v, str) else None for v in (getattr(row, c) for c in route))
            return generate.attempts_of(client_of(place), row.prompt, max_retries, sleep)

        for chunk in _dealt(batches, batch_size):
            digest = hashlib.sha256("\n".join(chunk["prompt_key"]).encode()).hexdigest()
            name = f"{folder}/chunk-{run}-{digest}.parquet"
            if store.get_file_info(name).type == fs.FileType.File:
                yield pd.DataFrame({"chunks": [1], "kept": [1], "calls": [0]})
                continue
            rows = [answered(row) for row in chunk.itertuples(index=False)]
            values = [list(chunk["prompt_key"]), *(list(v) for v in zip(*rows))]
            table = pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, _FILE)], schema=_FILE)
            part = f"{folder}/_part-{uuid.uuid4().hex}"  # such names are not read
            with store.open_output_stream(part) as out:
                parquet.write_table(table, out)
            store.move(part, name)
            yield pd.DataFrame({"chunks": [1], "kept": [0], "calls": [int(sum(r[3] for r in rows))]})

    dealt = wanted.repartition(tasks, "prompt_key").sortWithinPartitions("prompt_key")
    dealt.mapInPandas(write, _DONE).write.format("noop").mode("overwrite").save()
    return kept(spark, path)


def _held_back(call: Callable[[str], str], pace: Pace) -> Callable[[str], str]:
    def held(prompt: str) -> str:
        pace.wait()
        return call(prompt)

    return held


def best(answers: DataFrame) -> DataFrame:
    """``prompt_key, answer, status, error``: a good answer of each key, if it has one."""
    last = F.struct(F.col("status") == generate.OK, "status", "error", "answer")
    one = answers.groupBy("prompt_key").agg(F.max_by(F.struct("answer", "status", "error"), last).alias("g"))
    return one.select("prompt_key", "g.*")
