"""Mixing sources to target weights by hash thresholds.

Each source has a budget of words.  A budget of two and a half times its words is two whole
passes and a third one over the documents whose hash is below a threshold.  A histogram of
words by source and leading bits of the hash shows the bucket in which the threshold lies; only
that bucket's rows are counted again by their next bits, until it holds one hash.  Nothing is
sorted, and a row is chosen by its own hash and its source's threshold alone.

Thresholds nest: what a smaller budget takes of a document, a larger one takes too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from annospark.llm.common import ranked, read, stored

WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and of one source at most.
SHARE, MOST = 1.5, 2.0
#: Bits of a hash, and bits that one histogram tells apart.
BITS, STEP = 60, 12
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "place")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, its words, and ``place``, a hash of id and text of 60 bits.

    A null text has no words.  Columns of ``docs`` with these two names are replaced.
    """
    text = F.col(text_col).cast("string")
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    place = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    kept = [F.col(c) for c in docs.columns if c not in ADDED]
    return docs.select(*kept, size.alias("size"), place.alias("place"))


def targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
            source_col: str = "source") -> DataFrame:
    """(source, source_size, target): words that each source is to give.

    Sources in order of code points, null last, have ``weights`` in turn and share ``share`` of
    all words.  A source gives ``most`` times its words at most; what is over goes to the others by weight.
    """
    sums = rows.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    placed = ranked(sums.withColumn("last", F.col("source").isNull()), ["last", "source"], "sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    table = stored(placed.select("source", "source_size", weight.alias("weight"), cap.alias("cap")), "targets")
    level, before = 0.0, None
    while level != before:  # the level only rises, and with each rise a source is capped
        before = level
        over = F.lit(level) * F.col("weight") > F.col("cap")
        words, capped, left = table.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if left:
            level = (share * words - (capped or 0.0)) / left
    return table.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), "cap").alias("target"))


def _same(a: str, b: str = "source") -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(rows: DataFrame, wanted: DataFrame, source_col: str = "source") -> DataFrame:
    """Per source: ``passes`` over all of it, and what one more pass takes of it.

    That pass takes every ``place`` below ``edge`` (null: all of them) and, of the ``many``
    equal rows at ``edge``, ``some``: as many as bring the sum nearest to the target.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = wanted.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    state = stored(state.withColumn("start", F.lit(0).cast("long")), "budgets")
    names = ["source", "source_size", "target", "passes", "rest"]
    pending = rows.select(F.col(source_col).alias("_source"), "size", "place").filter("size > 0")
    found = None
    for shift in range(BITS - STEP, -1, -STEP):
        bucket = F.shiftright("place", shift)
        counts = pending.groupBy("_source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("many"), F.min("place").alias("edge"), F.max("place").alias("top"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        held = state.join(counts, _same("_source")).withColumn("start", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        # the first bucket that the rest of the budget does not cover; the one before is covered
        cross = held.filter((F.col("start") <= F.col("rest")) & (F.col("start") + F.col("words") > F.col("rest")))
        cross = stored(cross.select(*names, "start", "bucket", "words", "many", "edge", "top"), "bounds")
        if found is None:
            covered = state.join(cross.select(F.col("source").alias("_source")), _same("_source"), "left_anti")
            nothing = F.lit(None).cast("long")
            found = covered.select(*names, nothing.alias("edge"), F.lit(0).cast("long").alias("many"), F.lit(0).cast("long").alias("some"))
        one = F.col("words") / F.col("many")
        near = F.floor((F.col("rest") - F.col("start")) / one - 0.5) + 1
        single = cross.filter("edge = top").withColumn("some", F.least(F.greatest(near, F.lit(0)), "many").cast("long"))
        found = found.unionByName(single.select(*found.columns))
        state = cross.filter("edge <> top").select(*names, "start", "bucket")
        if state.isEmpty():
            break
        inside = state.select("source", "bucket")
        pending = stored(pending.join(inside, _same("_source") & (bucket == F.col("bucket"))).select("_source", "size", "place"), "boundary")
        state = state.drop("bucket")
    return stored(found, "thresholds")


def mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
        source_col: str = "source") -> DataFrame:
    """``rows`` of ``marked`` with their part in the mix.

    Adds source_size, target (its source's), copies (times the mix takes the document) and taken
    (words, repeats counted); columns of ``rows`` with these names are replaced.  The sum of a
    source's taken words is as near its target as whole documents in order of hash allow.  Rows of
    equal id and text are equal here: where only some of them are wanted, any are taken.  Rows
    without words have no part in a budget; sources without words have target 0.  A null source is
    a source.  An empty table gives none.  ``rows`` is read several times: store it, if that is dear.
    """
    added = ("source_size", "target", "copies", "taken")
    rows = rows.select(*[c for c in rows.columns if c not in added])
    edges = thresholds(rows, targets(rows, weights, share, most, source_col), source_col)
    edges = edges.select(F.col("source").alias("_source"), "source_size", "target", F.col("passes").alias("_passes"),
                         F.col("edge").alias("_edge"), F.col("some").alias("_some"), F.col("many").alias("_many"))
    joined = rows.join(edges, F.col(source_col).eqNullSafe(F.col("_source")))

    def out(df: DataFrame, more: Column) -> DataFrame:
        copies = F.when(F.col("source_size") > 0, F.col("_passes") + more.cast("long")).otherwise(F.lit(0).cast("long"))
        return df.withColumn("copies", copies).select(
            *rows.columns, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))

    whole = (F.col("place") < F.col("_edge")) | (F.col("place") == F.col("_edge")) & (F.col("_some") > 0)
    split = (F.col("_some") > 0) & (F.col("_some") < F.col("_many"))
    if edges.filter(split).isEmpty():
        return out(joined, F.coalesce(whole, F.lit(True)))
    # of equal rows at an edge, the first: counted by task, one row of each task and source in between
    at_edge = F.coalesce(split & (F.col("place") == F.col("_edge")), F.lit(False))
    equal = stored(joined.filter(at_edge).withColumn("_at", F.monotonically_increasing_id()), "equal")
    equal = equal.withColumn("_task", F.shiftright("_at", 33))
    tasks = equal.groupBy("_source", "_task").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("_source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.withColumn("_first", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    tasks = tasks.select(F.col("_source").alias("_other"), F.col("_task").alias("_there"), "_first")
    equal = equal.join(tasks, _same("_other", "_source") & (F.col("_task") == F.col("_there")))
    number = F.row_number().over(Window.partitionBy("_source", "_task").orderBy("_at")) + F.col("_first")
    equal = out(equal.withColumn("_number", number), F.col("_number") <= F.col("_some"))
    return out(joined.filter(~at_edge), F.coalesce(whole, F.lit(True))).unionByName(equal)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(marked(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "place"), "sizes")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS i FROM s
), l AS (  -- the level if the sources before this one stop at their cap
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM c WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least((SELECT arg_min(level, i) FROM l WHERE cap >= level * weight) * weight, cap) AS target FROM l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t
), r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.passes, target - passes * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
