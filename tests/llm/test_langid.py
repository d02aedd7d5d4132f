import math
import tracemalloc

import pytest

from annospark.llm import langid
from annospark.llm.common import crc_mod, read


def plain_bits(rows, lang, word):
    """Code length of a word, straight from the definition."""
    counts = {(c, b): n for la, c, b, n in rows if la == lang}
    data, total = b" " + word.encode() + b" ", 0.0
    for i in range(1, len(data)):
        p = 1.0
        for k in range(min(langid.ORDER, i), -1, -1):
            seen = {b: n for (c, b), n in counts.items() if c == data[i - k : i]}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                p *= seen[data[i]] / whole
                break
            p *= len(seen) / whole
        else:
            p /= 256
        total -= math.log2(p)
    return total


def test_code_lengths(spark):
    docs = spark.createDataFrame([(1, "die Katze und der Hund", "de"), (2, "the cat and the dog", "en"), (3, "x", None)], "doc_id long, text string, lang string")
    trees = langid.train(docs)
    rows = [(trees.langs[la], c, b, n) for c, by in trees.nodes.items() for la, seen in by.items() for b, n in seen.items()]
    coder = langid.Coder(trees)
    for word in ("katze", "the", "zzz", "é", "catdogcatdog"):
        for k, lang in enumerate(trees.langs):
            assert coder.code(word)[k] == pytest.approx(plain_bits(rows, lang, word))
    got = coder.text("The katze, 12 the zzz!")
    assert got == pytest.approx(coder.code("the") * 2 + coder.code("katze") + coder.code("zzz"))
    long = "ab" * 40_000
    assert coder.text(long) == pytest.approx(coder.code(long))


def test_rows_of_any_kind(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (4, "the dog", "en"), (4, "the dog", "en"), (None, "der Hund", "de"), (6, "le chien", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    trees = langid.train(docs)
    got = langid.identify(docs, trees)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "bits_per_byte"]
    by = got.collect()
    assert len(by) == 7
    assert {r.lang_pred for r in by if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in by)
    kept = langid.accepted(docs, trees)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4, 6]
    none = langid.train(docs.filter("false"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.filter("false"), trees).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in read(spark, sf, "documents").collect()}
    got = langid.op7_language_id(spark, sf).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert len(held) == read(spark, sf, "documents").filter(crc_mod("doc_id", 5) == 0).count() > 100
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_a_text_in_another_language_than_it_says_is_rejected(spark):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    trees = langid.train(docs.filter(crc_mod("doc_id", 5) != 0))
    one = {r.lang: r.text for r in docs.filter("length(text) > 400").collect()}
    rows = [(1, one["fr"], "en"), (2, one["fr"], "fr"), (3, one["fr"], None), (4, one["fr"], "xx"), (5, "on y va, ok", "en"), (6, one["en"], "de")]
    planted = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.accepted(planted, trees).collect()) == [2, 3, 4, 5]
    assert langid.accepted(planted.drop("lang"), trees).count() == 6
    kept = langid.accepted(docs, trees).count()
    assert docs.count() * 0.99 < kept <= docs.count()


def test_languages_share_the_counts(spark):
    rows = [(i * 100 + k, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * (3 if i else 40) + f"common {k}", f"l{i:02}") for i in range(40) for k in range(60 if i == 0 else 1 + i % 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid.train(docs, max_nodes=40 * 30)
    assert len(trees.langs) == 40
    nodes = spark.createDataFrame([("a", b"", i, 9 - i // 2) for i in range(8)] + [("b", b"", i, 1) for i in range(8)], "lang string, context binary, byte int, n long")
    kept = langid.frequent(nodes, 5).collect()
    assert sorted((r.lang, r.byte) for r in kept) == [("a", i) for i in range(4)] + [("b", i) for i in range(8)]


def test_a_task_keeps_the_model_only(spark):
    docs = spark.createDataFrame([(1, "der Hund", "de"), (2, "the dog", "en")], "doc_id long, text string, lang string")
    coder = langid.Coder(langid.train(docs))
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in "abc")
    coder.text("the dog")
    tracemalloc.start()
    try:
        coder.text(text)
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert kept < 1 << 20  # 52,728 different words


def test_only_texts_go_to_python_and_once(spark):
    docs = spark.createDataFrame([(1, "der Hund", "de", [{"a": 1}]), (2, "the dog", "en", None)], "doc_id long, text string, lang string, more array<map<string, int>>")
    trees = langid.train(docs)
    for found in (langid.identify(docs, trees), langid.accepted(docs, trees)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
        assert sorted((r.doc_id, r.lang, r.more) for r in found.collect()) == [(1, "de", [{"a": 1}]), (2, "en", None)]
