"""What several operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

T = TypeVar("T")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``.

    Only where a local session leaves it unset, as in tests, a temporary one is made,
    once per session, and named in the same setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage, so a lost executor costs one task of what follows, and gives the
    planner the true size of what it may broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(0))


def ranked(df: DataFrame, by: list[str], name: str, weight: str | None = None) -> DataFrame:
    """``df`` with its place in the order of ``by``, from 0, as ``rank``.

    With ``weight``, ``before`` is the sum of that column over all earlier rows.  The
    order is made by range partitions, sorted where they are; what goes through one
    task is one row per partition.
    """
    made = df.repartitionByRange(*by).sortWithinPartitions(*by)
    made = stored(made.withColumn("_at", F.monotonically_increasing_id()), name)
    made = made.withColumn("_part", F.shiftright("_at", 33))
    sums = [F.count("*").alias("_n")]
    if weight:
        sums.append(F.sum(weight).alias("_w"))
    parts = made.groupBy("_part").agg(*sums)
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_first"),
                          *([F.coalesce(F.sum("_w").over(over), F.lit(0)).alias("_start")] if weight else []))
    # one row per partition: never more than the partitions of one job
    out = made.join(F.broadcast(starts), "_part").withColumn(
        "rank", F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1))
    if weight:
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_start") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        out = out.drop("_start")
    return out.drop("_part", "_at", "_first")


#: Marks of ``marks``: 4 MB of bits, in words of 64, whatever is marked.
MARKS = 1 << 25


def marks(keys: DataFrame, key: str) -> DataFrame:
    """A table of bits, of bounded size, with one set for the hash of each value of ``key``."""
    rows = keys.filter(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(MARKS)).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    return stored(rows.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("_row")).agg(F.bit_or(bit).alias("_bits")), "marks")


def struck(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``df`` with ``_struck``: may ``key`` be among those marked?  Never false for one that is.

    A null key is not among them.  The table is sent to all tasks: half a million rows at most.
    """
    rows = df.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(MARKS))).withColumn("_row", F.floor(F.col("_slot") / 64).cast("int"))
    bit = F.expr("shiftright(_bits, cast(_slot % 64 as int)) & 1")
    hit = F.col(key).isNotNull() & F.coalesce(bit == 1, F.lit(False))
    return rows.join(F.broadcast(table), "_row", "left").withColumn("_struck", hit).drop("_slot", "_row", "_bits")


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], T]) -> T:
    """The model ``name`` of this worker process, made when first asked for.

    A worker that serves one operator after another holds the latest model only.
    """
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]
