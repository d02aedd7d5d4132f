"""Spelling variants by a variable-length gram index.

A dictionary holds the grams that are frequent among the words; a word is cut into grams that
grow, letter by letter, until they are in it no longer.  A gram's length thus depends on its own
letters alone, and one edit leaves alone the grams before it and most of those behind it.  How
many different grams it can harm at most is each word's own bound: of its grams in one global
order, rarest first, the bound plus one are put into the index, and two words one edit apart share
one of these.  As an edit leaves all before it, or all behind it, as it was, a gram is listed
with the whole beginning that it ends, and with the whole end that it begins.

Lists of more than ``LIST`` words are dealt anew by the letters that they leave open: one edit
spares the first or the last half of these.  What meets in a list is verified by edit distance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annospark.llm.common import read, stored

#: Letters in a gram: with 7 letters and both ends, no edit can harm all grams of up to 4.
SHORTEST, LONGEST = 2, 4
#: Grams of one length in the dictionary, at most, and occurrences of each, at least.
DICTIONARY, FREQUENT = 1 << 16, 64
#: Words of a list that are compared with one another.
LIST = 96
LETTERS, TIMES, RATIO = 7, 2, 10
START, END = "^", "$"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """(word, n): the words of at least ``letters`` code points that occur at least ``times`` times.

    A run of letters A-Z, a-z and U+00C0 to U+00FF in lower case (A-Z only) whose crc32 with its
    document's id is a multiple of 31 loses one code point.
    """
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{letters},}}"), F.lit(0))
    capital = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tokens = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    tokens = tokens.select("id", F.translate("run", capital, capital.lower()).alias("run"))
    tokens = tokens.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))).withColumn("long", F.length("run"))
    at = (F.col("h") % F.col("long")).cast("int")
    run = F.col("run")
    cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.col("long")))
    words = tokens.select(F.when(F.col("h") % 31 == 0, cut).otherwise(run).alias("word"))
    counts = words.filter(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= times)


def dictionary(words: DataFrame) -> dict[str, int]:
    """Frequent grams of the words and how often they occur; at most ``DICTIONARY`` of each length.

    All that are left out occur in fewer places than one in ``DICTIONARY``, so the bound is
    a threshold of frequency, which rises with the words.
    """
    chars = words.select(F.split(F.concat(F.lit(START), "word", F.lit(END)), "").alias("c"))
    total = chars.agg(F.sum(F.size("c"))).first()[0] or 0
    least = max(FREQUENT, -(-total // DICTIONARY))

    def grams(q: int) -> Column:
        places = F.slice("c", F.lit(1), F.size("c") - (q - 1))
        return F.transform(places, lambda x, i: F.concat(x, *[F.get("c", i + k) for k in range(1, q)]))

    every = F.concat(*[grams(q) for q in range(SHORTEST, LONGEST + 1)])
    counts = chars.select(F.explode(every).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return {gram: n for gram, n in counts.filter(F.col("n") > least).collect()}


def decompose(padded: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of the grams of a word with both its ends; none lies inside another."""
    out, top, size = [], 0, len(padded)
    for a in range(size - SHORTEST + 1):
        e = a + SHORTEST
        while e < size and e - a < LONGEST and padded[a:e] in frequent:
            e += 1
        if e > top:
            out.append((a, e))
            top = e
    return out


def harmed(padded: str, grams: list[tuple[int, int]], frequent: dict[str, int]) -> int:
    """The most different grams that one edit can harm: no place is left where they surely stay.

    An edit at i harms the grams that hold i.  One behind it stays unless a gram that begins at
    or before i could, with the letter changed, reach its end; that gram's letters behind i are then
    frequent up to its last one.  An inserted letter harms no more than a change of the one before.
    """
    names = [padded[a:e] for a, e in grams]
    total = Counter(names)
    single = len(total) == len(names)
    first, most = 0, 0
    for i in range(len(padded) - 1):
        while grams[first][1] <= i:
            first += 1
        hit = []
        for j in range(first, len(grams)):
            a, e = grams[j]
            if a > i and e - i > LONGEST:
                break
            if a <= i or e - i - 2 < SHORTEST or padded[i + 1 : e - 1] in frequent:
                hit.append(names[j])
        count = len(hit) if single else sum(n == total[g] for g, n in Counter(hit).items())
        most = max(most, count)
    return most


def places(word: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """(letters before, letters behind) that the lists of a word's first grams fix; one of both is 0."""
    padded = START + word + END
    grams = decompose(padded, frequent)
    order = sorted({padded[a:e] for a, e in grams}, key=lambda g: (frequent.get(g, 0), g))
    chosen = set(order[: harmed(padded, grams, frequent) + 1])
    size, out = len(padded), set()
    for a, e in grams:
        if padded[a:e] in chosen:
            if e < size:
                out.add((e - 1, 0))
            if a > 0:
                out.add((0, size - 1 - a))
    return sorted(out)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, kind, pre, suf) with the key of their list."""
    word = F.col("word")
    begin = F.substring(word, F.lit(1), F.col("pre"))
    end = F.when(F.col("suf") > 0, F.substring(word, F.length(word) - F.col("suf") + 1, F.col("suf"))).otherwise(F.lit(""))
    return rows.withColumn("key", F.xxhash64("kind", "pre", "suf", begin, end))


def lists(words: DataFrame, frequent: dict[str, int], limit: int = LIST) -> Iterator[DataFrame]:
    """Tables (key, word, n); any two words one edit apart share a key in one of them.

    ``kind`` 0 holds words of all lengths.  A list that is too long is dealt by lengths: kind c has the
    words of c and of c - 1 letters, so that a pair meets in that of the longer one.  After some
    rounds at most two letters are open, and a list has no more words than there are pairs of letters.
    """
    held = words.sparkSession.sparkContext.broadcast(frequent)  # bounded: see dictionary

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                found = [places(w, grams) for w in part.column(0).to_pylist()]
                rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
                flat = [p for f in found for p in f]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows),
                     pa.array([p for p, _ in flat], pa.int32()), pa.array([s for _, s in flat], pa.int32())],
                    ["word", "n", "pre", "suf"])

    rows = words.select("word", "n").mapInArrow(index, "word string, n long, pre int, suf int")
    rows = stored(_keyed(rows.withColumn("kind", F.lit(0))), "grams")
    while True:
        crowded = rows.groupBy("key").agg(F.count("*").alias("many")).filter(F.col("many") > limit)
        crowded = stored(crowded.select("key"), "crowded")
        if crowded.isEmpty():
            yield rows.select("key", "word", "n")
            return
        yield rows.join(crowded, "key", "left_anti").select("key", "word", "n")
        much = rows.join(crowded, "key")
        long = F.length("word")
        kinds = F.when(F.col("kind") > 0, F.array("kind")).otherwise(F.array(long, long + 1))
        much = much.select("key", "word", "n", "pre", "suf", "kind", F.explode(kinds).alias("next"))
        half = F.floor((F.col("next") - 1 - F.col("pre") - F.col("suf")) / 2).cast("int")
        much = stored(much.withColumn("half", half), "dealt")
        # a key of kind 0 holds both kinds of a pair, so such a list is told apart by the kind
        yield much.filter("half < 1").select(F.xxhash64("key", "next").alias("key"), "word", "n")
        deeper = much.filter("half >= 1").withColumn("kind", F.col("next"))
        both = F.array(F.struct((F.col("pre") + F.col("half")).alias("pre"), F.col("suf").alias("suf")),
                       F.struct(F.col("pre").alias("pre"), (F.col("suf") + F.col("half")).alias("suf")))
        deeper = deeper.select("word", "n", "kind", F.explode(both).alias("open")).select("word", "n", "kind", "open.*")
        rows = stored(_keyed(deeper), "grams")


def near(words: DataFrame, limit: int = LIST) -> DataFrame:
    """(word, n, other, other_n): both directions of every pair of words one edit apart, each once."""
    found = None
    for rows in lists(words, dictionary(words), limit):
        held = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("held")).filter(F.size("held") > 1)
        single = held.select(F.posexplode("held").alias("at", "a"), "held")
        # in the order of words, so that each pair is looked at once
        later = F.slice("held", F.col("at") + 2, F.size("held"))
        later = F.filter(later, lambda b: F.levenshtein(F.col("a.word"), b["word"], 1) == 1)
        pairs = single.select("a", F.explode(later).alias("b")).select(
            F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))
        pairs = stored(pairs, "near")
        found = pairs if found is None else found.unionByName(pairs)
    pairs = found.distinct()
    # both directions of a pair from one row, so that pairs are made different once
    there, back = F.struct("word", "n", "other", "other_n"), F.struct(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.select(F.inline(F.array(there, back)))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where ``forms`` (word, form) lead in the end; each round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, limit: int = LIST) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) for each word of ``vocabulary``.

    ``form`` is the most frequent word one edit away (ties: the smallest by code points) if it
    occurs at least ``ratio`` times as often, ``root`` the end of the chain of forms, the word itself
    without one.  Null and empty texts have no words; a null id counts as an empty one; repeated
    rows count each.  Other columns are ignored.  Without words there are no rows.
    """
    words = stored(vocabulary(docs, id_col, text_col), "words")
    links = near(words, limit)
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    often = -F.col("best.less") >= ratio * F.col("n")
    made = stored(joined.select(
        "word", F.when(often, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(made.filter("form is not null"))
    return made.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))
