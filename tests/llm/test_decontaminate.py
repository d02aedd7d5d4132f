import random

import numpy as np
import pytest

from annospark.llm import decontaminate as d
from annospark.llm.common import read


def plain_align(a, b):
    best, row = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        new = [0.0]
        for j, y in enumerate(b):
            new.append(max(0.0, row[j] + (d.MATCH if x == y else d.EDIT), row[j + 1] + d.EDIT, new[j] + d.EDIT))
        row, best = new, max(best, *new)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_alignment(seed):
    rng = random.Random(seed)
    a = [rng.randint(0, 4) for _ in range(rng.randint(1, 25))]
    b = [rng.randint(0, 4) for _ in range(rng.randint(0, 60))]
    score, begin, end = d.align(np.array(a), np.array(b))
    assert score == plain_align(a, b) == plain_align(a, b[begin:end])


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n)]


def test_copies_edits_and_clean_texts(spark):
    rng = random.Random(3)
    items = [words(rng, rng.randint(12, 60)) for _ in range(30)]
    docs, want = [], set()
    for k in range(200):
        body = words(rng, 150)
        if k % 4 == 0:
            i = rng.randrange(30)
            copy = [w if rng.random() > 0.12 else words(rng, 1)[0] for w in items[i]]
            at = rng.randrange(150)
            body[at:at] = copy
            want.add((k, i))
        docs.append((k, " ".join(body).capitalize()))
    bench = [(i, " ".join(w).title()) for i, w in enumerate(items)]
    # a passage in most documents is a leak all the same
    docs += [(1000 + k, " ".join(words(rng, 20)) + ", " + bench[0][1] + "!") for k in range(150)]
    want |= {(1000 + k, 0) for k in range(150)}
    for part in (d.PART_BYTES, 2000):
        got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), part_bytes=part).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    brute = {(k, i) for k, t in docs[:60] for i, w in bench if plain_align(d.words_of(w), d.words_of(t)) / len(w.split()) >= d.MIN_SHARE}
    assert brute == {x for x in want if x[0] < 60}


def test_rows_of_any_kind(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "one two three four five", "x"), (4, "one, TWO three four five", "x"), (4, "one two three four five", "x"), (5, "w " * 100_000, "x"), (6, "hi", "x")], "doc_id long, text string, share string")
    bench = spark.createDataFrame([(7, "one two three four five"), (7, "one two three four five"), (8, None), (9, ""), (None, "hi"), (10, "hi")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.share) for r in d.leaks(docs, bench).collect()) == [(4, 7, 1.0), (6, 10, 1.0)]
    assert sorted(r.doc_id or 0 for r in d.clean(docs, bench).collect()) == [0, 1, 2, 5]
    assert d.leaks(docs, bench.filter("false")).collect() == [] == d.leaks(docs.filter("false"), bench).collect()
    assert d.clean(docs, bench).columns == docs.columns


def test_query_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id): r.share for r in d.op10_decontaminate(spark, sf).collect()}
    squeezed = lambda t: b" " + b" ".join(d.words_of(t)) + b" "
    docs = [(r.doc_id, squeezed(r.text)) for r in read(spark, sf, "documents").collect()]
    exact = {(k, r.item_id) for r in read(spark, sf, "benchmark").collect() for k, t in docs if squeezed(r.text) in t}
    assert exact and exact <= got.keys() and all(got[x] == 1.0 for x in exact)
