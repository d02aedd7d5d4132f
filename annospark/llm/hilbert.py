"""Nearest neighbours by shifted space-filling curves.

Vectors are scaled by the largest norm and lifted by one coordinate to the sphere; a query is
scaled to the equator, so that the nearest on the sphere is the one of largest inner product.
For each of several curves they are turned by a random rotation, cut to a few coordinates,
shifted, and put in Hilbert order.  Range partitions give each vector its rank on each curve.
Ranks are cut into windows of equal size; a query looks into its own window and both
neighbours on every curve.  What all its windows hold is ranked by the exact inner product in
double precision.

How many curves a table needs is measured: a sample of at most ``SAMPLE`` queries is held
against all vectors, and rounds of fresh curves go on until what the windows found holds
``RECALL`` of the sample's true neighbours.

Equal vectors are one row here, with the smallest ids of those that have it: as many as a
query can use.  Windows hold equally many vectors whatever the data, so no key can fill a task.
Only ranks and row numbers are sorted; vectors go to their windows in single precision, whose
rounding is allowed for, and the originals are joined to the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from annospark.llm.common import ranked, read, stored

K = 20
#: Curves of a round.
CURVES = 12
#: Coordinates of a curve and bits of each.
AXES, BITS = 6, 10
#: Vectors in a window.
WINDOW = 2048
#: Queries held against all vectors, and the share of their neighbours that ends the rounds.
SAMPLE, RECALL = 256, 0.95
#: What rounding two unit vectors to single precision takes off their product at most.
ROUNDING = 2e-7
SEED = 20
FOUND = "row long, other long, low double, high double"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (whole numbers below 2 ** bits)."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns, from the largest cube down
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> b & 1
    return out


def frames(size: int, curves: range, axes: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rotation and shift of each curve, the same in every task."""
    out = []
    for c in curves:
        rng = np.random.default_rng([seed, c])
        turn, _ = np.linalg.qr(rng.standard_normal((size, max(size, 1))))
        out.append((turn[:, : min(axes, size)], rng.uniform(0, 1, min(axes, size))))
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(
        "id is not null and vec is not null and size(vec) > 0 and exists(vec, x -> x <> 0)"
        " and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def distinct(vectors: DataFrame, k: int) -> DataFrame:
    """(vec array<double>, ids array<long>): each usable vector once, with its k + 1 smallest ids.

    Each task first brings its own copies down to k + 1 ids, so one vector that has a third
    of all rows reaches the merge as a few rows of each task.
    """
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pd.DataFrame({"id": batch.column(0).to_numpy(), "vec": [np.asarray(v.values).tobytes() for v in batch.column(1)]})
            frame = frame.sort_values("id").groupby("vec", sort=False).head(k + 1)
            rows = [np.frombuffer(v).tolist() for v in frame.vec]
            yield pa.RecordBatch.from_arrays([pa.array(frame.id, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["id", "vec"])

    some = vectors.mapInArrow(least, "id long, vec array<double>")
    merged = some.groupBy("vec").agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"))
    return stored(merged, "vectors")


def stacked(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    return np.stack([np.asarray(column[int(i)].values) for i in rows])


def placed(points: DataFrame, curves: range, window: int, axes: int, seed: int) -> DataFrame:
    """(curve, w, row, there, size): the window of each vector, and of each query (``there`` 0), on each curve."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, asks, sizes, norms, tops = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                x, scale = stacked(batch.column(0), some), norms[some] / tops[some]
                x = x / norms[some, None]
                there = np.column_stack([x * scale[:, None], np.sqrt(np.maximum(0.0, 1.0 - scale**2))])
                seeks = asks[some]
                both = np.concatenate([there, np.column_stack([x[seeks], np.zeros(seeks.sum())])])
                names = np.concatenate([rows[some], rows[some][seeks]])
                held = np.concatenate([np.ones(len(some), np.int32), np.zeros(seeks.sum(), np.int32)])
                for c, (turn, shift) in zip(curves, frames(both.shape[1], curves, axes, seed)):
                    flat = both @ turn * np.sqrt(both.shape[1]) / 3.0  # most fall within one
                    cells = np.clip((flat + 1 + shift) / 3 * (1 << BITS), 0, (1 << BITS) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(both), c, np.int32)), pa.array(hilbert(cells)), pa.array(names), pa.array(held),
                         pa.array(np.full(len(both), size, np.int32))], ["curve", "key", "row", "there", "size"])

    keyed = points.select("vec", "row", "asks", "size", "norm", "largest").mapInArrow(keys, "curve int, key long, row long, there int, size int")
    order = ranked(keyed, ["size", "curve", "key", "row", "there"], "curves", weight="there")
    return order.select("curve", F.floor(F.col("before") / window).cast("long").alias("w"), "row", "there", "size")


def met(points: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(row, other, low, high): of each query the vectors in its windows that may be among the ``k`` + 1 best.

    The product of the query, scaled to length one, with the vector, scaled by the largest, lies between low and high.
    """
    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, tops = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            units = [(np.asarray(v.values) / n).astype(np.float32).tobytes() for v, n in zip(batch.column(1), norms)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary()), pa.array(norms / tops)], ["row", "unit", "scale"])

    units = points.select("row", "vec", "norm", "largest").mapInArrow(single, "row long, unit binary, scale double")
    beside = F.explode(F.when(F.col("there") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    dealt = places.withColumn("d", beside).withColumn("w", F.col("w") + F.col("d")).drop("d").join(units, "row")

    def best(key, frame: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame([], columns=["row", "other", "low", "high"])]
        for size, part in frame.groupby("size"):
            seeks, there = part[part.there == 0], part[part.there == 1]
            if not len(seeks) or not len(there):
                continue
            scale, names = there.scale.to_numpy(), there.row.to_numpy()
            held = np.frombuffer(b"".join(there.unit), np.float32).reshape(-1, size).astype(np.float64) * scale[:, None]
            slack = ROUNDING * scale
            for at in range(0, len(seeks), 256):
                rows = seeks.row.to_numpy()[at : at + 256]
                scores = np.frombuffer(b"".join(seeks.unit[at : at + 256]), np.float32).reshape(-1, size).astype(np.float64) @ held.T
                low, high = scores - slack, scores + slack
                take = min(k + 1, low.shape[1])
                i, j = np.nonzero(high >= np.partition(low, -take, axis=1)[:, -take][:, None])
                out.append(pd.DataFrame({"row": rows[i], "other": names[j], "low": low[i, j], "high": high[i, j]}))
        return pd.concat(out)

    return dealt.groupBy("curve", "w").applyInPandas(best, FOUND)


def foremost(pairs: DataFrame, k: int) -> DataFrame:
    """Of different pairs those that may be among the ``k`` + 1 best of their query."""
    once = pairs.groupBy("row", "other").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    order = Window.partitionBy("row").orderBy(F.desc("low"), "other")
    edge = F.min(F.when(F.col("place") <= k + 1, F.col("low"))).over(Window.partitionBy("row"))
    return once.withColumn("place", F.row_number().over(order)).withColumn("edge", edge).filter("high >= edge").drop("place", "edge")


def truth(points: DataFrame, k: int, seed: int, sample: int = SAMPLE) -> DataFrame:
    """(row, least, n): of a sample of queries the product of the ``k``-th nearest, of all vectors but itself, and how many there are."""
    rows = points.filter("asks").orderBy(F.xxhash64("row", F.lit(seed))).limit(sample).select("row", "vec", "size", "norm").collect()
    asked = {}  # at most ``sample`` rows
    for size in {r["size"] for r in rows}:
        some = [r for r in rows if r["size"] == size]
        asked[size] = np.array([r.row for r in some]), np.array([np.array(r.vec) / r.norm for r in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {size: np.full((len(names), 0), -np.inf) for size, (names, _) in asked.items()}
        for batch in batches:
            names, sizes, tops = (batch.column(i).to_numpy() for i in (1, 2, 3))
            for size in held.keys() & set(sizes.tolist()):
                some = np.flatnonzero(sizes == size)
                scores = asked[size][1] @ (stacked(batch.column(0), some) / tops[some, None]).T
                scores[asked[size][0][:, None] == names[some]] = -np.inf
                held[size] = -np.sort(-np.concatenate([held[size], scores], axis=1), axis=1)[:, :k]
        for size, best in held.items():
            i, j = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(asked[size][0][i]), pa.array(best[i, j])], ["row", "score"])

    each = points.select("vec", "row", "size", "largest").mapInArrow(run, "row long, score double")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))
    return stored(each.withColumn("place", place).filter(F.col("place") <= k).groupBy("row").agg(
        F.min("score").alias("least"), F.count("*").alias("n")), "truth")


def recall(found: DataFrame, sample: DataFrame) -> float:
    """Share of the sample's neighbours that were found; another one as near counts as well."""
    hits = found.filter("row <> other").join(F.broadcast(sample), "row").filter("high >= least").groupBy("row").agg(F.count("*").alias("hits"))
    row = sample.join(hits, "row", "left").agg(F.sum(F.least("n", F.coalesce("hits", F.lit(0)))), F.sum("n")).first()
    return row[0] / row[1] if row[1] else 1.0


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, curves: int = CURVES,
           window: int = WINDOW, axes: int = AXES, seed: int = SEED, least_recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for each query.

    ``queries`` are rows of ``vectors``; a query is no candidate of its own.  Vectors null,
    empty, zero or with null or non-finite components take no part, nor do rows without id;
    vectors of other lengths than the query's are no candidates.  Repeated ids count once; a
    query id with several vectors has one list for each.  Ties go to the smaller id.  Fewer than
    ``k`` candidates are all returned where a window holds them all.  No vectors or no queries give no rows.
    """
    points = distinct(usable(vectors, id_col, vec_col), k)
    asked = usable(queries, id_col, vec_col).distinct().withColumnRenamed("id", "query_id")
    points = points.withColumn("size", F.size("vec")).withColumn("norm", F.sqrt(F.expr("aggregate(vec, 0d, (s, x) -> s + x * x)")))
    largest = points.groupBy("size").agg(F.max("norm").alias("largest"))
    points = points.join(largest, "size").join(asked.select("vec").distinct().withColumn("asks", F.lit(True)), "vec", "left")
    points = stored(points.withColumn("asks", F.coalesce("asks", F.lit(False))).withColumn("row", F.monotonically_increasing_id()), "points")
    sample = truth(points, k, seed)
    found, done = None, 0
    while found is None or recall(found, sample) < least_recall:
        new = met(points, placed(points, range(done, done + curves), window, axes, seed), k)
        found = stored(foremost(new if found is None else new.unionByName(found), k), "found")
        done += curves
    seekers = points.filter("asks").select("row", "vec")
    pairs = found.select("row", "other").join(seekers, "row").join(
        points.select(F.col("row").alias("other"), F.col("vec").alias("held"), "ids"), "other")
    score = F.expr("aggregate(zip_with(vec, held, (x, y) -> x * y), 0d, (s, x) -> s + x)")
    single = pairs.select("row", F.explode("ids").alias("vec_id"), score.alias("score"))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    top = single.withColumn("place", place).filter(F.col("place") <= k + 1)
    names = asked.join(seekers, "vec").select("query_id", "row")
    named = top.join(names, "row").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy("place")).cast("int")
    return named.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
