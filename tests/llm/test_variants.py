import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from annospark.llm import variants
from annospark.llm.common import read

COLUMNS = "doc_id long, text string"


def counted(rows):
    """Words by the definition, one token at a time."""
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_apart(words):
    """Every pair one edit apart, from what words are with one letter blotted out or left out."""
    blots = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            blots[w[:i] + "?" + w[i + 1 :]].add(w)
    out = defaultdict(set)
    for group in blots.values():
        for w in group:
            out[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                out[w].add(shorter), out[shorter].add(w)
    return out


def brute(rows):
    words = counted(rows)
    links = one_apart(words)
    form = {}
    for w, n in words.items():
        best = min(links[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(links[w]), words[form[w]] if form[w] else None))
    return out


def got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    docs = read(spark, f"/root/testdata/{sf}", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(variants.op13_variants(spark, f"/root/testdata/{sf}")) == want
    assert any(w[1] for w in want) or sf == "sf0.001"


def test_crowded_lists_are_dealt_anew(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice([7, 8, 9, 10]))) for _ in range(900)}
    words |= {"transport" + a + b for a in "abcdefgh" for b in "abcdefgh"}
    rows = [(w, rng.choice([2, 30, 400])) for w in sorted(words)]
    df = spark.createDataFrame(rows, "word string, n long")
    links = one_apart(words)
    for limit in (3, 40, 1 << 20):
        found = [(r.word, r.other) for r in variants.near(df, limit).collect()]
        assert sorted(found) == sorted((a, b) for a, some in links.items() for b in some)


def test_pairs_share_a_list_for_any_dictionary():
    """The bound of harmed grams holds: no pair is lost, whichever grams are frequent."""
    rng = random.Random(7)
    for _ in range(4000):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        grams = {a + b for a in letters + "^" for b in letters if rng.random() < 0.7}
        frequent = {g: rng.randrange(100) for g in grams}
        frequent |= {g + c: rng.randrange(50) for g in grams for c in letters if g[1] + c in grams and rng.random() < 0.7}
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(8, 14)))
        i, c = rng.randrange(len(a)), rng.choice(letters)
        b = rng.choice([a[:i] + c + a[i + 1 :], a[:i] + a[i + 1 :], a[:i] + c + a[i:]])

        def keys(w):
            return {(w[:p], w[len(w) - s :] if s else "", p, s) for p, s in variants.places(w, frequent)}

        assert keys(a) & keys(b), (a, b)
        padded = "^" + a + "$"
        some = variants.decompose(padded, frequent)
        assert variants.harmed(padded, some, frequent) < len({padded[x:y] for x, y in some})


def test_chains_lead_to_their_end(spark):
    chain = [("aaaaaaa", "aaaaaab"), ("aaaaaab", "aaaaabb"), ("aaaaabb", "aaaabbb"), ("aaaabbb", "aaabbbb"), ("aaabbbb", "aabbbbb")]
    df = spark.createDataFrame(chain, "word string, form string")
    assert {r.word: r.root for r in variants.roots(df).collect()} == {w: "aabbbbb" for w, _ in chain}


def test_rows_of_any_kind(spark):
    rows = [
        (1, None), (2, ""), (3, "short words only"), (None, "Zebrafish zebrafish"), (None, "Zebrafish zebrafish"),
        (4, "zebrafisch " * 3), (4, "zebrafisch " * 3), (5, "ÀÉîôûçñ àÉîôûçñ ÀÉîôûçñ"), (6, "x" * 30000), (7, "x" * 30000),
        (8, "x" * 29999 + "y"), (9, "x" * 29999 + "y"), (10, "zebrafish " * 60), (11, "一二三四五六七八 😀".encode("utf-16", "surrogatepass").decode("utf-16")),
    ]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], COLUMNS + ", word string, n long")
    assert got(variants.variants(df)) == brute(rows)
    empty = variants.variants(df.limit(0))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


def test_ties_go_to_the_smallest(spark):
    rows = [(100, "bananas " * 2)] + [(i, "bananaz bananax ") for i in range(200, 260)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert got(variants.variants(df)) == brute(rows)
    assert {r.word: r.form for r in variants.variants(df).collect()}["bananas"] == "bananax"


def test_pairs_are_made_different_once(spark):
    words = spark.createDataFrame([("letters", 9), ("lettera", 3), ("letter", 2), ("another", 2)], "word string, n long")
    found = variants.near(words)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    assert sorted((r.word, r.n, r.other, r.other_n) for r in found.collect()) == [
        ("letter", 2, "lettera", 3), ("letter", 2, "letters", 9), ("lettera", 3, "letter", 2),
        ("lettera", 3, "letters", 9), ("letters", 9, "letter", 2), ("letters", 9, "lettera", 3)]
