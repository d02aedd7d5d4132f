import math
from collections import Counter

import pytest

from annospark.llm import quality as q
from annospark.llm.common import crc_mod, read


def plain_model(texts, order):
    counts = {order: Counter()}
    for text in texts:
        data = b"\n" * (order - 1) + " ".join(text.split()).encode()
        counts[order].update(data[i : i + order] for i in range(len(data) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off = {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        off[k] = [min(max(q.LEAST_DISCOUNT, i - (i + 1) * y * n[i + 1] / n[i]), i) if n[i] and y is not None else 0.5 for i in (1, 2, 3)]

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        after = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        d = lambda n: off[k][min(n, 3) - 1]
        total = sum(after.values())
        share = max(0.0, after[g] - d(after[g])) / total if g in after else 0.0
        return share + sum(map(d, after.values())) / total * p(g[1:])

    return p


def plain_perplexity(p, text, order):
    data = b"\n" * (order - 1) + " ".join(text.split()).encode()
    n = len(data) - order + 1
    return 2 ** (-sum(math.log2(p(data[i : i + order])) for i in range(n)) / n)


@pytest.mark.parametrize("settings", [{}, {"broadcast_grams": 0, "broadcast_ids": 0, "block_bytes": 40}])
def test_model_equals_its_definition(spark, settings):
    texts = {1: "the cat sat on the mat and the hat", 2: "the dog  sat on\nthe log", 3: "a zebra?", 4: "the cat", 5: "", 6: None, 7: "éé der Hund"}
    rows = [(i, t, "de" if i == 7 else "en", 0.5) for i, t in texts.items()] + [(None, "the cat", "en", 0.5), (4, "the cat", "en", 0.5), (8, "x", None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, bits double")
    trusted = spark.createDataFrame([(1,), (2,), (2,)], "doc_id long")
    got = q.perplexity(docs, trusted, order=3, **settings).collect()
    assert len(got) == len(rows)
    p = plain_model([texts[1], texts[2]], 3)
    for r in got:
        if r.doc_id in (5, 6, 7, 8):
            assert r.perplexity is None
        else:
            assert r.perplexity == pytest.approx(plain_perplexity(p, texts.get(r.doc_id, "the cat"), 3), rel=1e-5)
    assert q.perplexity(docs.filter("false"), trusted.filter("false")).collect() == []


def test_long_text_in_slices(monkeypatch):
    text = "abc déf " * 500
    whole = [int(x) for part in q.codes(text) for x in part]
    monkeypatch.setattr(q, "_SLICE", 7)
    assert [int(x) for part in q.codes(text) for x in part] == whole


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = q.op8_quality(spark, sf).collect()
    assert len(got) == read(spark, sf, "documents").count()
    good = {r.doc_id for r in read(spark, sf, "labels").filter("quality = 1").filter(crc_mod("doc_id", 5) == 0).collect()}
    held = [r for r in got if r.doc_id in good]
    assert sum(r.keep for r in held) / len(held) > 0.9
    assert all(r.keep == (r.perplexity is None or r.threshold is None or r.perplexity <= r.threshold) for r in got)
