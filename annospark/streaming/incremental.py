"""Coverage kept current while files change.

A micro-batch scans only the files it brings and appends their counts, one small row
per file, under a folder named after the batch; a removed file leaves a row without counts.
Replaying a batch writes the same folder again.  The current state is the newest row per path, and
source text is never part of it.

After ``COMPACT`` batches the newest rows of all of them become one base table.  A small file names
the base in use and is replaced in one move, so a reader sees the state before or after.  What
the base before it made obsolete is removed only then, so a reader that has just looked finds its files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from annospark.operators import coverage as cov, scan

STATE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("readable", T.BooleanType()),
        T.StructField("total", T.LongType()),
        T.StructField("documented", T.LongType()),
        T.StructField("batch", T.LongType()),
    ]
)


#: Batches between two base tables.
COMPACT = 16
POINTER = "_current"


def file_counts(files: DataFrame) -> DataFrame:
    """``path, group, readable, total, documented`` per file; null group.

    A file whose boolean column ``deleted`` is true has been removed: its counts are null.
    """
    gone = F.coalesce("deleted", F.lit(False)) if "deleted" in files.columns else F.lit(False)
    rows = scan.records(scan.headers(files.withColumn("_gone", gone)))
    is_function = F.col("line_number").isNotNull() & ~F.col("is_class")
    return rows.groupBy("path").agg(
        F.lit(None).cast("string").alias("group"),
        F.bool_and(F.col("error").isNull()).alias("readable"),
        F.when(~F.bool_or("_gone"), F.count_if(is_function)).alias("total"),
        F.when(~F.bool_or("_gone"), F.count_if(is_function & F.col("has_docstring"))).alias("documented"),
    )


def newest(files: DataFrame, *order: str) -> DataFrame:
    """Last row per path, for batches that may bring a path more than once."""
    rest = [c for c in files.columns if c != "path"]
    last = files.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select("path", "_last.*")


def incremental_coverage(
    stream: DataFrame,
    state_path: str,
    checkpoint: str,
    counts: Callable[[DataFrame], DataFrame] = file_counts,
    order: Sequence[str] = (),
    compact: int = COMPACT,
):
    """Start a query that takes in all rows available now and then ends.

    ``counts`` turns the rows of one batch into state rows, one per path.  Where a path
    can come twice in a batch, name the columns of ``order`` that tell which row is the
    newest.  Both paths must be on storage all executors share.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = _base(state_path)
        if batch_id <= base:  # a replay of a batch that the base holds already
            return
        rows = counts(newest(batch, *order) if order else batch).select("path", "group", "readable", "total", "documented")
        rows.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
        if len(_batches(state_path, base)) >= compact:
            compact_state(spark, state_path)

    return (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _base(state_path: str) -> int:
    """Last batch that the base in use holds; -1 without one."""
    from pyarrow import fs

    store, inner = _store(state_path)
    if store.get_file_info(f"{inner}/{POINTER}").type != fs.FileType.File:
        return -1
    with store.open_input_stream(f"{inner}/{POINTER}") as stream:
        return int(stream.read())


def _batches(state_path: str, base: int) -> list[int]:
    """Numbers of the batches after ``base``."""
    from pyarrow import fs

    store, inner = _store(state_path)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True))]
    return sorted(n for n in (int(x[6:]) for x in names if x.startswith("batch=")) if n > base)


def compact_state(spark: SparkSession, state_path: str) -> None:
    """Put the newest rows of all batches into a base table and use it from then on."""
    from pyarrow import fs

    before = _base(state_path)
    batches = _batches(state_path, before)
    if not batches:
        return
    upto = batches[-1]
    rows = current_state(spark, state_path).withColumn("batch", F.lit(upto).cast("long"))
    rows.select(*STATE.names).write.mode("overwrite").parquet(f"{state_path}/base/{upto}")
    store, inner = _store(state_path)
    part = f"{inner}/{POINTER}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(str(upto).encode())
    store.move(part, f"{inner}/{POINTER}")
    # the base before, and its batches, stay for readers that still use them
    for entry in store.get_file_info(fs.FileSelector(f"{inner}/base", allow_not_found=True)):
        if int(entry.base_name) < before:
            store.delete_dir(entry.path)
    for n in _batches(state_path, -1):
        if n <= before:
            store.delete_dir(f"{inner}/batch={n}")


def current_state(spark: SparkSession, state_path: str) -> DataFrame:
    """Newest row per path, without the removed ones."""
    base = _base(state_path)
    paths = [f"{state_path}/batch={n}" for n in _batches(state_path, base)]
    rows = spark.createDataFrame([], STATE)
    if base >= 0:
        rows = rows.unionByName(spark.read.schema(STATE).parquet(f"{state_path}/base/{base}"))
    if paths:
        rows = rows.unionByName(spark.read.schema(STATE).option("basePath", state_path).parquet(*paths))
    newest = F.max_by(F.struct("group", "readable", "total", "documented"), "batch").alias("s")
    return rows.groupBy("path").agg(newest).select("path", "s.*").where("total is not null")


def current_coverage(spark: SparkSession, state_path: str, by_group: bool = False) -> DataFrame:
    """Coverage over the current state."""
    keys = ["group"] if by_group else []
    sums = current_state(spark, state_path).groupBy(*keys).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("documented"), F.lit(0)).alias("documented"),
        F.count_if(~F.col("readable")).alias("skipped_files"),
    )
    return sums.withColumn("coverage_pct", cov.percentage(F.col("documented"), F.col("total")))
