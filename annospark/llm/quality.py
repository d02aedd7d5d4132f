"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is of bytes, ``ORDER`` long, one for each language, trained on trusted documents.
Its counts are tables of Spark: trusted n-grams are counted, each lower order counts the
different bytes before an n-gram, three discounts come from the counts of counts, and joins
by n-gram, sharded by Spark, make the probabilities

    p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + gamma(h) * p(w | h')

down to 1 / 256.  Every different n-gram of the corpus is looked up once, by joins that try
the shorter histories in turn.  Documents then need only the table of their own n-grams: it
is sent to the tasks if it has at most ``BROADCAST_GRAMS`` rows; beyond that the documents
are dealt into blocks, and each block meets the n-grams that occur in it.

A document is kept unless its perplexity is above the ``QUANTILE`` of its language, taken
from trusted documents that the model has not seen.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annospark.llm.common import crc_mod, read, stored

#: Bytes in an n-gram; up to 7 fit a key.
ORDER = 5
QUANTILE = 0.99
LEAST_DISCOUNT = 0.05
#: Most n-grams, of 12 bytes each, that every task gets whole.
BROADCAST_GRAMS = 4_000_000
#: Most trusted ids, of 16 bytes each, that every task gets whole.
BROADCAST_IDS = 2_000_000
BLOCK_BYTES = 64 << 20
_SLICE = 1 << 20


def codes(text: str | None, order: int = ORDER) -> Iterator[np.ndarray]:
    """The n-gram that ends at each byte of the text, as numbers, in slices; white space counts as one blank."""
    data = b"\n" * (order - 1) + " ".join((text or "").split()).encode("utf-8", "replace")
    for at in range(0, len(data) - order + 1, _SLICE):
        d = np.frombuffer(data[at : at + _SLICE + order - 1], dtype=np.uint8).astype(np.int64)
        n = len(d) - order + 1
        key = d[:n].copy()
        for k in range(1, order):
            key <<= 8
            key |= d[k : k + n]
        yield key


class _Tally:
    """Different n-grams and their counts, merged as they come."""

    def __init__(self) -> None:
        self.keys, self.counts, self.new, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, part: np.ndarray) -> None:
        self.new.append(part)
        self.size += len(part)
        if self.size > max(1 << 21, len(self.keys)):
            self.merge()

    def merge(self) -> "_Tally":
        if self.new:
            keys, counts = np.unique(np.concatenate(self.new), return_counts=True)
            both, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
            sums = np.zeros(len(both), np.int64)
            np.add.at(sums, at, np.concatenate([self.counts, counts]))
            self.keys, self.counts, self.new, self.size = both, sums, [], 0
        return self


def grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(block, lang, gram, n): n-grams of (block, lang, trusted, text); n counts the trusted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, _Tally] = defaultdict(_Tally)
        for batch in batches:
            for block, lang, trusted, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                tally = seen[block, lang, trusted]
                for part in codes(text.as_py(), order):
                    tally.add(part)
        for (block, lang, trusted), tally in seen.items():
            tally.merge()
            n = len(tally.keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block, np.int32)), pa.array([lang] * n, pa.string()), pa.array(tally.keys),
                 pa.array(tally.counts if trusted else np.zeros(n, np.int64))], ["block", "lang", "gram", "n"])

    made = docs.select("block", "lang", "trusted", "text").mapInArrow(run, "block int, lang string, gram long, n long")
    return made.groupBy("block", "lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(gram: Column, bytes_: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * bytes_) - 1))


def _discount(i: int, y: Column) -> Column:
    """What is taken off a count of ``i``; half a count where too few counts give the formula no value."""
    raw = i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
    # never nothing, or a history would leave no share to what it has not seen
    held = F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(i)), raw))  # both pass over nulls
    return F.when(raw.isNull(), 0.5).otherwise(held).alias(f"d{i}")


def model(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """From (lang, gram, n) of the highest order: for each order from 1 on, (lang, gram, p) and (lang, history, gamma)."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy("lang", _suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n"))
    out, below = [], None
    for k in range(1, order + 1):
        c = levels[k]
        few = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        # one row per language, of known size: else the join would deal all n-grams by language
        tally = stored(c.groupBy("lang").agg(*few).select("lang", *[_discount(i, y) for i in (1, 2, 3)]), f"tally{k}")
        own = c.join(tally, "lang").withColumn("history", F.shiftright("gram", 8)).withColumn(
            "d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        history = own.groupBy("lang", "history").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("gamma"))
        part = own.join(history, ["lang", "history"]).withColumn("share", F.greatest(F.lit(0.0), F.col("n") - F.col("d")) / F.col("total"))
        if below is None:
            p = part.select("lang", "gram", (F.col("share") + F.col("gamma") / 256).alias("p"))
        else:
            lower = below.select("lang", F.col("gram").alias("_s"), F.col("p").alias("_p"))
            p = part.withColumn("_s", _suffix(F.col("gram"), k - 1)).join(lower, ["lang", "_s"]).select(
                "lang", "gram", (F.col("share") + F.col("gamma") * F.col("_p")).alias("p"))
        below = stored(p, f"order{k}")
        out.append((below, stored(history.select("lang", "history", "gamma"), f"history{k}")))
    return out


def bits(types: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(lang, gram, bits) of different n-grams (lang, gram), by the longest history that has seen them."""
    order = len(levels)
    now = types.select("lang", "gram", F.lit(1.0).alias("paid"))
    done = None
    for k in range(order, 0, -1):
        p, history = levels[k - 1]
        now = now.withColumn("_s", _suffix(F.col("gram"), k)).join(p.select("lang", F.col("gram").alias("_s"), "p"), ["lang", "_s"], "left")
        now = stored(now, f"seen{k}")
        hit = now.filter("p is not null").select("lang", "gram", (F.col("paid") * F.col("p")).alias("p"))
        done = hit if done is None else done.unionByName(hit)
        now = now.filter("p is null").withColumn("history", F.shiftright("_s", 8)).join(history, ["lang", "history"], "left").select(
            "lang", "gram", (F.col("paid") * F.coalesce("gamma", F.lit(1.0))).alias("paid"))
    done = done.unionByName(now.select("lang", "gram", (F.col("paid") / 256).alias("p")))
    return done.select("lang", "gram", (-F.log2("p")).cast("float").alias("bits"))


def _lookup(keys: np.ndarray, values: np.ndarray, text: str | None, order: int) -> tuple[float, int]:
    total, n = 0.0, 0
    for part in codes(text, order):
        part.sort()  # neighbours in the table are neighbours in memory
        total += float(values[np.searchsorted(keys, part)].sum(dtype=np.float64))
        n += len(part)
    return total, n


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, bits) -> a row of bytes for each language and batch."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        keys, values = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        some = sorted(set(langs))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.string()), pa.array([keys[langs == x].tobytes() for x in some], pa.binary()),
             pa.array([values[langs == x].tobytes() for x in some], pa.binary())], ["lang", "keys", "bits"])


def perplexity(docs: DataFrame, trusted: DataFrame, order: int = ORDER, broadcast_grams: int = BROADCAST_GRAMS,
               broadcast_ids: int = BROADCAST_IDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity) of each row of ``docs``, per byte.

    trusted: the doc_ids of the training text, each once.  Null and empty texts, and
    languages without training text, have no perplexity.  A null language is one of its own.
    """
    spark = docs.sparkSession
    ids = stored(trusted.select(F.col("doc_id").cast("long").alias("_id")).filter("_id is not null").distinct(), "trusted")
    ids = ids.withColumn("trusted", F.lit(True))
    side = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marked = rows.join(side, rows.doc_id == ids._id, "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))).withColumn("block", F.lit(0))
    counted = stored(grams(marked, order).select("lang", "gram", "n"), "grams")
    train = counted.filter("n > 0")
    scored = stored(bits(counted.join(train.select("lang").distinct(), "lang", "left_semi"), model(train, order)), "bits")
    schema = "doc_id long, lang string, n_bytes long, bits double"

    def measured(table, batch_rows) -> list[tuple]:
        out = []
        for doc, lang, text in batch_rows:
            keys, values = table.get(lang, (None, None))
            total, n = _lookup(keys, values, text, order) if keys is not None else (None, sum(map(len, codes(text, order))))
            out.append((doc, lang, n, total if n else None))
        return out

    if scored.count() <= broadcast_grams:
        parts = defaultdict(list)
        for lang, keys, values in scored.mapInArrow(_packed, "lang string, keys binary, bits binary").collect():
            parts[lang].append((np.frombuffer(keys, np.int64), np.frombuffer(values, np.float32)))
        table = {}
        for lang, found in parts.items():
            keys, values = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            place = np.argsort(keys)
            table[lang] = keys[place], values[place]
        shared = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = measured(shared.value, zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (x.as_py() for x in batch.column(2))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.float64()))],
                    ["doc_id", "lang", "n_bytes", "bits"])

        found = rows.mapInArrow(run, schema)
    else:
        blocks = max(1, -(-size // block_bytes))
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).withColumn("trusted", F.lit(False))
        own = grams(dealt, order).join(scored, ["lang", "gram"]).select("block", "lang", "gram", "bits")

        def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            table = {lang: (p.gram.to_numpy(), p.bits.to_numpy()) for lang, p in right.sort_values("gram").groupby("lang")}
            out = measured(table, zip(left.doc_id.astype(object).where(left.doc_id.notna(), None), left.lang, left.text))
            return pd.DataFrame(out, columns=["doc_id", "lang", "n_bytes", "bits"]).astype({"doc_id": "Int64"})

        found = dealt.select("block", "doc_id", "lang", "text").groupBy("block").cogroup(own.groupBy("block")).applyInPandas(block, schema)
    return found.select("doc_id", F.nullif("lang", F.lit("")).alias("lang"), "n_bytes", F.pow(F.lit(2.0), F.col("bits") / F.col("n_bytes")).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, **settings) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, keep) for each row of ``docs``.

    Trusted are the documents labelled quality 1: those whose crc32(id) mod 5 is not 0 train,
    the others set the threshold of their language.  Without a perplexity or a threshold a
    document is kept.  Of several labels of an id the largest counts; rows without id are
    scored; repeated rows give a row each; other columns are ignored.
    """
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality > 0")
    found = stored(perplexity(docs, good.filter(crc_mod("doc_id", 5) != 0), **settings), "perplexity")
    held = good.filter(crc_mod("doc_id", 5) == 0).select(F.col("doc_id").cast("long").alias("doc_id"))
    limits = found.join(held, "doc_id", "left_semi").groupBy(F.coalesce("lang", F.lit("")).alias("_lang")).agg(
        F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("threshold"))
    return found.join(limits, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left").select(
        "doc_id", "lang", "n_bytes", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
