import random

from pyspark.sql import functions as F

import corpus_pipeline
from annospark.llm import minhash
from annospark.llm.common import marks, read, struck


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def plain(rows):
    """Ids that stay: the smallest of each group connected by similarity 0.8."""
    sets, root = {d: grams(t) for d, t in rows}, {d: d for d, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    return sorted(set(root.values()))


def test_edited_copies_go_in_the_pipeline(spark):
    rng = random.Random(8)
    rows = []
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 400]))]
        for c in range(8):  # more and more edits: similarity from 1 down past 0.8
            copy = list(words)
            for i in rng.sample(range(len(copy)), c * len(copy) // 200 if c else 0):
                copy[i] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    chain = [f"c{i}" for i in range(200)]  # a chain whose ends are not alike
    for c in range(8):
        rows.append((len(rows), " ".join(chain[c * 12 : c * 12 + 100])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert 1 < len(want) < len(rows) - 12
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == want


def test_rows_of_any_kind(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (4, "a b"), (None, "A  b"), (None, "q r s t"), (None, "q r s t"), (7, long), (8, long + " x")]
    docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, kind string")
    kept = minhash.keep_one(docs).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept) == [(0, "q r"), (1, ""), (4, "a b"), (7, "w0 ")]
    assert kept[0].__fields__ == docs.columns
    assert minhash.keep_one(docs.filter("false")).collect() == []


def test_marks_strike_what_is_marked_and_little_else(spark):
    keys = spark.range(0, 50_000, 7).withColumnRenamed("id", "k")
    rows = spark.range(-1000, 60_000).withColumn("k", F.when(F.col("id") >= 0, F.col("id")))
    got = struck(rows, "k", marks(keys, "k"))
    assert got.columns == ["id", "k", "_struck"]
    inside = (F.col("id") % 7 == 0) & F.col("id").between(0, 49_999)
    assert got.filter(inside & ~F.col("_struck")).count() == 0
    assert got.filter("id < 0 and _struck").count() == 0
    assert got.filter(~inside & F.col("_struck")).count() < 100
    assert struck(rows, "k", marks(keys.limit(0), "k")).filter("_struck").count() == 0


def test_crowded_buckets_of_unlike_texts(spark, monkeypatch):
    """Many different texts share one long passage; some are near copies of one another."""
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(120)]
    rows = []
    for k in range(60):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for c in range(3):
            edit = list(own)
            for i in range(c * 3):
                edit[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(shared + edit)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    for crowd in (2, 8, 1000):
        monkeypatch.setattr(minhash.links, "__defaults__", (crowd,))
        assert sorted(r.doc_id for r in minhash.keep_one(df).collect()) == want


def test_one_large_group_of_near_copies_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHARE", 50)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(400):
        copy = list(words)
        copy[rng.randrange(2, 98)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    rows += [(1000, "something else altogether " * 3)]
    assert sorted(r.doc_id for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 1000]


def test_equal_to_brute_force_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    kept = minhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == want and kept.columns == docs.columns
