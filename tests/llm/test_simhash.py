import random

import numpy as np
import pytest
import xxhash

from annospark.llm import simhash
from annospark.llm.common import read


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def plain_components(rows, distance=3):
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        r = find(f)
        least[r] = min(d, least.get(r, d))
    return {d: least[find(f)] for d, f in rows}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in read(spark, sf, "documents").collect()]
    want = plain_components(rows)
    got = simhash.op6_simhash(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in rows}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("limit", [4, 2048])
def test_crowded_bits_and_chains(spark, limit):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {0, 2**64 - 1}
    for b in base:  # many values few bits around one, and a chain that walks away from it
        fps |= {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)}
        for _ in range(40):
            b ^= sum(1 << k for k in rng.sample(range(64), 3))
            fps.add(b)
    rows = list(enumerate(sorted(fps)))
    signed = np.array([f for _, f in rows], dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    edges = simhash.links(df, limit=limit, open_bits=14)
    roots = {r.a: r.root for r in simhash.components(edges).collect()}
    want = plain_components(rows)
    of = dict(zip(signed, want.values()))
    groups = {}
    for s in signed:
        groups.setdefault(roots.get(s, s), set()).add(of[s])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(want.values()))


def test_rows_of_any_kind(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (4, "a b"), (None, "a b"), (None, "q r s t"), (None, "q r s t"), (7, long), (8, long + " x")]
    docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].component_id == by[3].component_id == 1 and by[1].fingerprint == "0" * 16
    assert by[8].component_id == 7
    assert [r.component_id for r in got if r.doc_id is None and r.fingerprint == by[4].fingerprint] == [4]
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept) == [(0, "q r"), (1, ""), (4, "a b"), (7, "w0 ")]
    assert kept[0].__fields__ == docs.columns
    assert simhash.near_duplicates(docs.filter("false")).collect() == []
