import random

import numpy as np

import corpus_pipeline
from annospark.llm import minhash


def near_pair(rng, size):
    """Two sets of hashes of which one has a fifth more, or each has a ninth of its own: similarity 0.8."""
    own = [np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64) for n in (size, size // 8, size // 8)]
    a, b = np.concatenate(own[:2]), np.concatenate([own[0], own[2]])
    return (np.unique(a), np.unique(b)) if rng.random() < 0.5 else (np.unique(a), np.unique(own[0]))


def test_blocks_meet_and_distance_holds_at_the_least_similarity():
    rng = random.Random(4)
    for size in (8, 40, 160, 800):
        for _ in range(100):
            (fa, ka), (fb, kb) = (minhash.blocks(x) for x in near_pair(rng, size))
            assert np.bitwise_count((fa ^ fb).view(np.uint64)).sum() <= minhash.APART
            assert (ka == kb).any()
    apart = [minhash.blocks(np.array([rng.getrandbits(64) for _ in range(100)], dtype=np.uint64))[0] for _ in range(200)]
    assert sum(np.bitwise_count((a ^ b).view(np.uint64)).sum() <= minhash.APART for a in apart for b in apart) < 210


def test_unlike_texts_are_no_candidates_by_chance():
    """Of 5,000 unrelated texts none passes the Hamming check; else candidates grow with the square of the table."""
    rng = np.random.default_rng(6)
    held = rng.integers(0, 1 << 63, (5000, 60), dtype=np.uint64)
    prints = np.stack([minhash.blocks(np.sort(x))[0] for x in held]).view(np.uint64)
    assert minhash.hamming(prints, len(prints)) == []


def grouped(n, links):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[top(i)] = top(j)
    return [top(i) for i in range(n)]


def test_large_buckets_are_split_and_lose_no_near_rows():
    rng = np.random.default_rng(2)
    alone = rng.integers(0, 1 << 63, (600, 2), dtype=np.uint64) * 2 + rng.integers(0, 2, (600, 2), dtype=np.uint64)
    copies = np.repeat(alone[:1], 1500, axis=0)
    copies[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)
    few = alone[1:40] ^ (np.uint64(1) << rng.integers(0, 64, (39, 2), dtype=np.uint64))
    rows = np.concatenate([alone, copies, few])
    for whole in (minhash.WHOLE, 16, 5000):
        found = grouped(len(rows), minhash.hamming(rows, whole))
        assert len({found[i] for i in [0, *range(600, 2100)]}) == 1
        assert all(found[1 + k] == found[2100 + k] for k in range(39))
        assert len(set(found)) == 600


def test_stage_gets_its_candidates_from_simhash(spark, monkeypatch):
    """Where the Hamming check lets nothing through, no two documents are compared."""
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    monkeypatch.setattr(minhash, "hamming", lambda prints: [])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 2, 3]
