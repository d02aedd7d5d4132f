"""SimHash near-duplicates: pigeonhole blocks, Hamming check, connected texts.

A fingerprint has six blocks of bits.  Two fingerprints that differ in at most three bits
agree on at least three blocks, so each is dealt to twenty buckets, one for each choice of
three blocks, and close pairs meet in one.  Inside a bucket the Hamming distance decides;
what leaves it is a spanning forest, never all pairs.  A bucket of more than ``LIMIT``
fingerprints is dealt anew by the bits that it leaves open, with the same argument: four
parts, one of which must agree.  After at most three such steps 14 bits are open, so
that no bucket can hold more than 16,384 different fingerprints.

Copies share a fingerprint and are linked as one row, so that a third of all rows in one
group costs nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from annospark.llm.common import read, shared_root, stored

BITS = 64
#: Largest bucket that is compared as it is, while bits are left to split it by.
LIMIT = 2048
#: Open bits at which a bucket is compared whatever its size.
OPEN = 14


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits by majority over XXH64 (seed 42) of the word shingles; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    hashes = np.fromiter(map(digest, map(b" ".join, runs)), dtype="<u8")
    # a sum of bits per column, in slices: a text of 20,000 words stays within a few MB
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def wide(hashes: np.ndarray, words: int, seed: int = 0) -> np.ndarray:
    """64 bits a word, as 0 and 1, by majority over hashes (unsigned longs) that a mixer spreads over all of them."""
    steps = np.arange(1 + seed * 4096, 1 + seed * 4096 + words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(words * 64, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # so many bits fit the sum of a byte
        x = hashes[at : at + 255, None] + steps
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (ones * 2 > len(hashes)).astype(np.uint8)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (doc_id, fp) for each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            fps = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, fp long")


def _parts(bits: list[int], n: int) -> list[int]:
    """``n`` masks that share out ``bits``, as evenly as they go."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks(distance: int) -> list[int]:
    """Masks of which two fingerprints at most ``distance`` bits apart agree under one."""
    blocks = _parts(list(range(BITS)), 2 * distance)
    return [_signed(sum(x)) for x in combinations(blocks, distance)]


def _forest(x: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links from each value to the first of those it is connected with."""
    bits, left, out = x.view(np.uint64), np.arange(len(x)), []  # counts bits of unsigned values only
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(front), 256):
                apart = np.bitwise_count(bits[front[at : at + 256], None] ^ bits[left][None, :])
                near |= (apart <= distance).any(axis=0)
            front, left = left[near], left[~near]
            out += [(int(x[i]), int(x[root])) for i in front]
    return out


def _linker(distance: int, limit: int, open_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: list[int] = []
        a: list[int] = []
        b: list[int] = []
        state = {"key": None, "held": [], "n": 0, "deal": False, "sub": []}

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(masks, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["mask", "a", "b"])
            masks.clear(), a.clear(), b.clear()
            return made

        def deal() -> None:
            for part in state["held"]:
                for sub in state["sub"]:
                    masks.extend([sub] * len(part))
                    a.extend(part.tolist())
                    b.extend([0] * len(part))
            state["held"] = []

        def close() -> None:
            if state["deal"]:
                deal()
            elif state["n"] > 1:
                links = _forest(np.unique(np.concatenate(state["held"])), distance)
                masks.extend([0] * len(links))
                a.extend(x for x, _ in links)
                b.extend(y for _, y in links)

        def take(mask: int, key: int, part: np.ndarray) -> None:
            if state["key"] != (mask, key):
                close()
                state.update(key=(mask, key), held=[], n=0, deal=False)
            state["held"].append(part)
            state["n"] += len(part)
            if state["n"] > limit and not state["deal"]:
                rest = [i for i in range(BITS) if not mask >> i & 1]
                if len(rest) > open_bits:
                    state["sub"] = [_signed((mask | x) & (1 << 64) - 1) for x in _parts(rest, distance + 1)]
                    state["deal"] = True
            if state["deal"]:
                deal()

        for batch in batches:
            m, f = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            v = m & f
            cuts = np.flatnonzero((m[1:] != m[:-1]) | (v[1:] != v[:-1])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(f)]
            # groups of one inside a batch are alone for good
            some = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(f)))
            for s, e in zip(starts[some].tolist(), ends[some].tolist()):
                take(int(m[s]), int(v[s]), f[s:e])
                if len(a) > 50_000:
                    yield emit()
        close()
        yield emit()

    return run


def links(fps: DataFrame, distance: int = 3, limit: int = LIMIT, open_bits: int = OPEN) -> DataFrame:
    """Links (a, b) that connect what is at most ``distance`` bits apart; ``fps``: one fp a row."""
    masks = F.array(*[F.lit(x).cast("long") for x in first_masks(distance)])
    rows = fps.select(F.explode(masks).alias("mask"), "fp")
    found = None
    while True:
        key = F.col("mask").bitwiseAND(F.col("fp"))
        dealt = rows.repartition("mask", key).sortWithinPartitions("mask", key, "fp")
        out = stored(dealt.mapInArrow(_linker(distance, limit, open_bits), "mask long, a long, b long"), "simhash")
        own = out.filter("mask = 0").select("a", "b")
        found = own if found is None else found.unionByName(own)
        rows = out.filter("mask <> 0").select("mask", F.col("a").alias("fp"))
        if rows.isEmpty():
            return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root): the smallest node that each node of ``edges`` (a, b) is connected with.

    Large star and small star in turn until nothing changes; each round is checkpointed.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))

    def tidy(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = tidy(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).checkpoint()
    before = None
    while (state := mark(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", F.col("m")).unionByName(least.select(F.col("u").alias("v"), "m"))
        now = tidy(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).checkpoint()
    return now.select(F.col("u").alias("a"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3,
                    shingle: int = 3, limit: int = LIMIT) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows and
    repeated ids give a row each.  A row without id keeps it null; where no row of a group
    has an id its component_id is null.  Other columns are ignored; an empty table gives none.
    """
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = stored(least, "classes")
    roots = components(links(least.select("fp"), distance, limit))
    rooted = least.join(roots.withColumnRenamed("a", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(groups, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of smallest id.

    Of repeated ids one row stays.  Rows without id go where their group has a document
    with one; otherwise one of each fingerprint stays.
    """
    found = near_duplicates(docs, **settings)
    named = docs.join(found.filter("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi")
    named = named.dropDuplicates(["doc_id"])
    bare = docs.filter("doc_id is null")
    if bare.isEmpty():
        return named
    shingle = settings.get("shingle", 3)
    one = F.pandas_udf(lambda s: s.map(lambda t: fingerprint(t, shingle) - (1 << 63)), "long")
    loose = found.filter("component_id is null").select("fingerprint").distinct()
    bare = bare.withColumn("_fp", one("text")).withColumn(
        "fingerprint", F.lower(F.lpad(F.hex(F.col("_fp").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))
    bare = bare.join(loose, "fingerprint", "left_semi").dropDuplicates(["fingerprint"])
    return named.unionByName(bare.select(*docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
