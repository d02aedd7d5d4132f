import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

from annospark.llm import mixing
from annospark.llm.common import read

COLUMNS = "doc_id long, text string, source string"


def brute(rows, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """(doc_id, source, size) to the sorted list of copies, by sorting and exact fractions."""
    docs = defaultdict(list)
    for doc_id, text, source in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        key = f"{'' if doc_id is None else doc_id}:{text or ''}".encode()
        docs[source].append((hashlib.md5(key).hexdigest()[:15], doc_id, size))
    names = sorted(docs, key=lambda s: (s is None, s or ""))
    words = {s: sum(d[2] for d in docs[s]) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, budget, target = set(names), share * sum(words.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > most * words[s]}
        for s in over or left:
            target[s] = Fraction(most * words[s]) if over else level * weight[s]
            budget -= target[s]
        left -= over or left
    out = defaultdict(list)
    for s in names:
        passes = target[s] // words[s] if words[s] else 0
        rest, before = target[s] - passes * words[s], 0
        for _, doc_id, size in sorted(docs[s], key=lambda d: d[0]):
            more = before + Fraction(size, 2) <= rest
            before += size
            out[doc_id, s, size].append(size * (passes + more))
    return {k: sorted(v) for k, v in out.items()}, words, target


def check(df, rows, **settings):
    want, words, target = brute(rows, **settings)
    out, taken, largest = defaultdict(list), defaultdict(int), defaultdict(int)
    for r in df.collect():
        out[r.doc_id, r.source, r.size].append(r.taken)
        assert r.taken == r.copies * r.size and r.source_size == words[r.source]
        assert abs(r.target - target[r.source]) <= 1e-9 * max(1, target[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert {k: sorted(v) for k, v in out.items()} == want
    for s in words:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    return taken


def made(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in read(spark, sf, "documents").collect()]
    check(mixing.mix(mixing.marked(read(spark, sf, "documents"))), rows)
    first, again = (sorted(mixing.op11_mixing(spark, sf).collect()) for _ in range(2))
    assert first == again and len(first) == len(rows)
    assert all(r.taken <= 2 * r.size for r in first)


def test_hot_source_and_one_very_long_document(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 40), "hot" if rng.random() < 0.4 else f"s{rng.randrange(30):02}") for i in range(4000)]
    rows += [(9000, "long " * 50000, "s03"), (9001, "only " * 7, "z")]
    check(mixing.mix(mixing.marked(made(spark, rows))), rows)


def test_equal_rows_are_split_where_the_budget_ends(spark):
    rows = [(5, "one two three", "a")] * 1000 + [(6, "four", "b")] * 999 + [(7, "x " * 40, "c")] * 3000
    df = made(spark, rows).repartition(7)
    check(mixing.mix(mixing.marked(df)), rows)


def test_smaller_budgets_nest(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 30), f"s{i % 5}") for i in range(600)]
    marked = mixing.marked(made(spark, rows))
    before = defaultdict(int)
    for share in (0.1, 0.5, 0.9, 1.0, 1.2, 1.7):
        now = {r.doc_id: r.copies for r in mixing.mix(marked, share=share).collect()}
        assert all(now[d] >= before[d] for d in now)
        before = now


def test_weights_and_caps(spark):
    rows = [(1, "a " * 10, "a"), (2, "b " * 1000, "b"), (3, "c " * 500, "c"), (4, "d", "d"), (5, "e " * 90, None)]
    _, words, target = brute(rows)
    got = {r.source: r.target for r in mixing.mix(mixing.marked(made(spark, rows))).collect()}
    assert got["a"] == 20 and got["d"] == 2
    assert all(abs(got[s] - target[s]) < 1e-9 * target[s] for s in words)
    check(mixing.mix(mixing.marked(made(spark, rows)), weights=(1, 3), share=2.5), rows, weights=(1, 3), share=Fraction(5, 2))


def test_rows_of_any_kind(spark):
    rows = [(None, None, None), (None, "a b", None), (1, "", "s"), (2, " \t\n", "s"), (3, "x y z", ""), (3, "x y z", ""), (4, None, "empty")]
    check(mixing.mix(mixing.marked(made(spark, rows))), rows)
    wide = spark.createDataFrame([(*r, 9, 9, 9, "k") for r in rows], COLUMNS + ", size int, target int, place int, bucket string")
    out = mixing.mix(mixing.marked(wide))
    check(out, rows)
    assert out.columns == ["doc_id", "text", "source", "bucket", "size", "place", "source_size", "target", "copies", "taken"]
    assert mixing.mix(mixing.marked(wide.limit(0))).count() == 0
