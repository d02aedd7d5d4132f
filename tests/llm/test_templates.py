import random
from collections import defaultdict

import pytest

from annospark.llm import templates as t
from annospark.llm.common import read


def form(line):
    """(tokens, may it join a family?) of a line by the definition."""
    raw = [x for x in line.replace("\t", " ").replace("\r", " ").split(" ") if x]
    masked = [t.FIELD if any(c in "0123456789" for c in x) else x for x in raw]
    constant = sum(x != t.FIELD for x in masked)
    if len(raw) < t.MIN_TOKENS or 2 * constant < len(raw):
        return tuple(raw), False
    return tuple(masked), len(raw) > t.LEAD


def alike(a, b):
    same = [x for x, y in zip(a[t.LEAD :], b[t.LEAD :]) if x == y]
    return len(same) >= t.SIMILAR * len(a[t.LEAD :]) and any(x != t.FIELD for x in same)


def plain(rows):
    """{(doc, text): lines kept} by the definition: each leaf is gone through template by template."""
    lines = [(d, x, p, *form(line)) for d, x in set(rows) if d is not None and x is not None for p, line in enumerate(x.split("\n"))]
    lines = [r for r in lines if r[3]]
    docs, leaves = defaultdict(set), defaultdict(set)
    for d, _, _, k, free in lines:
        docs[k].add(d)
        if free:
            leaves[len(k), k[: t.LEAD]].add(k)
    first = {k: min(v) for k, v in docs.items() if len(v) >= (2 if len(" ".join(k).encode()) >= t.LONG else t.MIN_DOCS)}
    general = {}
    for ks in leaves.values():
        found = []
        for k in sorted(ks, key=lambda k: (-len(docs[k]), min(docs[k]), " ".join(k).encode())):
            family = next((f for f in found if alike(f[0], k)), None)
            if family is None:
                found.append([k])
            else:
                family.append(k)
        for family in found:
            held = set().union(*(docs[k] for k in family))
            if len(held) >= t.MIN_DOCS:
                general |= {k: min(held) for k in family}
    gone = defaultdict(set)
    for d, x, p, k, _ in lines:
        if d != first.get(k, d) or d != general.get(k, d):
            gone[d, x].add(p)
    return {(d, x): "\n".join(y for p, y in enumerate(x.split("\n")) if p not in gone[d, x]) if x is not None else None for d, x in rows}


def kept(spark, rows):
    got = t.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((d, x) for (d, _), x in plain(rows).items())
    return {r.doc_id: r.text for r in got}


def test_what_stays_and_what_goes(spark):
    clean = ["I do not know it", "I do not like cats", "I do not sell bread", "1 2 3", "44 55 66", "7 8 9", "Page 4", "Page 5", "Page 6"]
    got = kept(spark, list(enumerate(clean)))
    assert list(got.values()) == clean
    passage = " ".join(f"word{chr(97 + i % 26)}" for i in range(50))
    unbroken = "\u6f22\u5b57" * 30
    rows = [(i, x) for i, x in enumerate([passage, "a\n" + passage, unbroken, unbroken + "\nb", *["Cookie settings"] * 4, *["1 2 3"] * 3])]
    got = kept(spark, rows)
    assert got[1] == "a" and got[3] == "b" and [got[i] for i in range(4, 11)] == ["Cookie settings", "", "", "", "1 2 3", "", ""]


def test_several_families_in_a_leaf_and_ties(spark, monkeypatch):
    monkeypatch.setattr(t, "SEEDS", 1)
    names = ["ann", "bob", "cid", "dan"]
    rows = [f"the node alpha was started by {x} today" for x in names] + [f"the node alpha has no room for {x}" for x in names]
    rows += [f"the node alpha {x} {x}a {x}b {x}c {x}d" for x in names]
    got = kept(spark, list(enumerate(rows)))
    assert [i for i, x in got.items() if x] == [0, 4, 8, 9, 10, 11]
    rng = random.Random(5)
    rows = [(i, "\n".join(" ".join(["in", "the", "end", *rng.choices("abc1", k=rng.choice([2, 5, 6]))]) for _ in range(3))) for i in range(120)]
    kept(spark, rows)


def test_templates_and_fields(spark):
    rows = [
        (1, "User 12 logged in from host a1\nunique line of the first one"), (2, "User 99 logged in from host b7\nanother line, quite unlike it"),
        (3, "User 5 logged in from host c3\nhey"), (4, "hey\nhey\nAll rights reserved.\nuser x"), (5, "All rights reserved.\n\nhey"), (6, "All\trights  reserved.\r\nmine alone it is"),
        (7, "the node alpha was started by root today"), (8, "the node alpha was started by admin today"), (9, "the node alpha was halted by root today"),
        (10, None), (11, ""), (None, "All rights reserved."), (12, "mine"), (12, "mine"), (13, "User 1 logged in from host a1\n" * 3),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or ""), "z") for r in rows], "doc_id long, text string, n_chars int, leaf string")
    got = t.dedup_lines(df).collect()
    assert len(got) == len(rows)
    want = plain(rows)
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((d or 0, want[d, x] or "") for d, x in rows)
    by = {r.doc_id: r for r in got}
    assert by[2].text == "another line, quite unlike it" and by[3].text.endswith("hey") and by[5].text == "" and by[8].text == by[9].text == "" and by[7].text == rows[6][1]
    assert by[1].n_dropped == 0 and by[2].n_chars == len(by[2].text) and by[10].text is None and by[13].text == ""
    assert t.dedup_lines(df.filter("false")).collect() == []


def test_long_texts(spark):
    line = "one two three four five"
    many = "\n".join(f"line number {chr(97 + i % 26)} {'x' * (i % 7)} {i} end" for i in range(40_000))
    rows = [(1, line), (2, line + "\n" + many), (3, line), (4, "y" * 300_000 + "1"), (5, many)]
    got = {r.doc_id: r for r in t.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].text == "" and got[2].n_dropped >= 1 and not got[2].text.startswith(line) and got[4].n_dropped == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_on_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in read(spark, f"/root/testdata/{sf}", "documents").collect()]
    got = {r.doc_id: r.text for r in t.op2_line_dedup(spark, f"/root/testdata/{sf}").collect()}
    want = {d: x for (d, _), x in plain(rows).items()}
    assert got.keys() == want.keys()
    assert {d for d in got if got[d] != want[d]} == set()
    assert sum(len(x or "") for x in got.values()) < sum(len(x or "") for _, x in rows)
