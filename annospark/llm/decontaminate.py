"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

One pass over the documents finds which n-grams of the test items each of them holds.  From
that the corpus tells how many documents hold each n-gram, and an item's seeds are those
in at most ``RARE`` times as many as its median one.  Rarity is measured inside the item,
so a passage that has leaked into a third of all documents keeps its seeds.  The documents with a seed are read once
more and aligned with the items, by words, around the seeds.

Test items go to the tasks in parts of at most ``PART_BYTES``; a larger benchmark takes
several passes and no more memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from annospark.llm.common import read, stored

#: Words in a seed.
SEED_WORDS = 3
#: A seed is in at most so many times the documents that the item's median n-gram is in.
RARE = 4
#: Text of test items that a pass holds in each task.
PART_BYTES = 16 << 20
#: Share of an item's words that the alignment has to reach, net of edits ...
MIN_SHARE = 0.4
#: ... or words, net of edits, which are a leak however long the item is.
MIN_WORDS = 25
MATCH, EDIT = 1.0, -0.5

# ASCII marks that part words
_MARKS = bytes.maketrans(*(lambda s: (s, b" " * len(s)))(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(_MARKS).split()


def grams(words: list[bytes], n: int):
    return zip(*(words[k:] for k in range(n)))


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two rows of word ids: score, begin and end in ``text``.

    Row by row; inside a row the gaps along the text are a running maximum.
    """
    n = len(text)
    steps = EDIT * np.arange(n + 1)
    row, begin = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    for word in item:
        cross = np.where(text == word, MATCH, EDIT) + row[:-1]
        down = row + EDIT
        new, came = down.copy(), begin.copy()
        better = cross > new[1:]
        new[1:][better], came[1:][better] = cross[better], begin[:-1][better]
        none = new <= 0
        new[none], came[none] = 0.0, np.flatnonzero(none)
        lifted = new - steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= top, np.arange(n + 1), 0))
        along = top + steps
        row, begin = np.maximum(along, 0.0), came[source]
        i = int(row.argmax())
        if row[i] > best[0]:
            best = (float(row[i]), int(begin[i]), i)
    return best


class Items:
    """Part of a benchmark: the words of each item and where its n-grams are."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.ids = [r[0] for r in rows]
        self.words = [words_of(r[1]) for r in rows]
        #: words in a gram -> gram -> its number; items of fewer words are one gram
        self.grams: dict[int, dict[tuple, int]] = defaultdict(dict)
        #: gram -> (item, place)
        self.at: list[list[tuple[int, int]]] = []
        for i, words in enumerate(self.words):
            size = min(n, len(words))
            for k, g in enumerate(grams(words, size) if size else ()):
                number = self.grams[size].setdefault(g, len(self.at))
                if number == len(self.at):
                    self.at.append([])
                self.at[number].append((i, k))

    def hits(self, words: list[bytes]) -> list[int]:
        return sorted(known[g] for size, known in self.grams.items() for g in known.keys() & set(grams(words, size)))

    def rare(self, docs_with: dict[int, int]) -> set[tuple[int, int]]:
        """(gram, item) of each item's grams that are rare beside its others."""
        own: dict[int, set[int]] = defaultdict(set)
        for g, places in enumerate(self.at):
            for i, _ in places:
                own[i].add(g)
        out = set()
        for i, numbers in own.items():
            counts = sorted(docs_with.get(g, 0) for g in numbers)
            limit = RARE * max(1, counts[(len(counts) - 1) // 2])
            out |= {(g, i) for g in numbers if docs_with.get(g, 0) <= limit}
        return out

    def leaks(self, words: list[bytes], seeds: dict[int, list[int]]) -> Iterator[tuple]:
        """(item id, share, score, begin, end) of each item that ``words`` hold a copy of."""
        near: dict[int, list[int]] = defaultdict(list)
        for size, known in self.grams.items():
            for k, g in enumerate(grams(words, size)):
                if (number := known.get(g)) is not None:
                    for i in seeds.get(number, ()):
                        near[i].append(k)
        if not near:
            return
        code: dict[bytes, int] = {}
        text = np.array([code.setdefault(w, len(code)) for w in words])
        for i, places in near.items():
            places.sort()
            item = self.words[i]
            ids = np.array([code.get(w, -1) for w in item])
            best, start = (0.0, 0, 0), places[0]
            for k, place in enumerate(places):
                last = k + 1 == len(places)
                # seeds further apart than two lengths of the item are different copies
                if last or places[k + 1] - place > 2 * len(item):
                    begin, end = max(0, start - 2 * len(item)), place + 2 * len(item)
                    score, a, b = align(ids, text[begin:end])
                    if score > best[0]:
                        best = (score, begin + a, begin + b)
                    start = places[k + 1] if not last else 0
            share = best[0] / len(item)
            if share >= MIN_SHARE or best[0] >= MIN_WORDS:
                yield self.ids[i], share, best[0], best[1], best[2]


def _part_leaks(docs: DataFrame, items: Items) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sizes = [(size, known.keys(), known) for size, known in own.grams.items()]
        for batch in batches:
            ids, found = [], []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(x.as_py())
                hit = [known[g] for size, keys, known in sizes for g in set(filter(known.__contains__, grams(words, size)))]
                if hit:
                    ids.append(doc)
                    found.append(hit)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grams"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    held = stored(rows.mapInArrow(find, "doc_id long, grams array<int>"), "seeds")
    # one count for each gram of a part
    counts = held.select("doc_id", F.explode("grams").alias("gram")).distinct().groupBy("gram").count().collect()
    seeds: dict[int, list[int]] = defaultdict(list)
    for g, i in sorted(items.rare({r[0]: r[1] for r in counts})):
        seeds[g].append(i)
    chosen = spark.sparkContext.broadcast(dict(seeds))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, *leak) for doc, x in zip(batch.column(0).to_pylist(), batch.column(1))
                   for leak in shared.value.leaks(words_of(x.as_py()), chosen.value)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
                ["doc_id", "item_id", "share", "score", "begin_word", "end_word"])

    # no more rows than the part has n-grams
    known = F.broadcast(spark.createDataFrame([(g,) for g in seeds], "gram int"))
    marked = held.select("doc_id", F.explode("grams").alias("gram")).join(known, "gram", "left_semi")
    marked = stored(marked.select("doc_id").distinct(), "candidates")
    # broadcast by the planner only where the written table is small
    return rows.join(marked, "doc_id", "left_semi").mapInArrow(
        verify, "doc_id long, item_id long, share double, score double, begin_word long, end_word long")


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row (doc_id, item_id, share, score, begin_word, end_word) for each item that a document copies.

    share: alignment score by the item's words.  Words are what white space and ASCII marks
    part, in ASCII lower case.  Items without id or words match nothing; nor do null texts.
    A document without id cannot be named and gives no row.  Repeated documents count
    once, the better row of each pair stays.  Empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).filter(
        "item_id is not null and trim(text) <> ''").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // part_bytes)
    found = None
    for k in range(parts):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # at most about part_bytes
        own = _part_leaks(docs, Items(sorted(tuple(r) for r in part), n))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, share double, score double, begin_word long, end_word long")
    best = F.max(F.struct("share", "score", -F.col("begin_word"), -F.col("end_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.share", "b.score", (-F.col("b.col3")).alias("begin_word"), (-F.col("b.col4")).alias("end_word"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that copy a test item; documents without id stay."""
    dirty = stored(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(dirty, "doc_id", "left_anti").select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
