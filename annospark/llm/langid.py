"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes, counted on a sample
of labelled documents and then frozen.  A byte's probability is its share in the longest
context that has seen it; each shorter step pays the escape probability of the context
left behind (method C: distinct / (total + distinct)), down to 1/256.  The code length of
a document is the exact sum over the bytes of its words, each with a blank before and
after, and the language of the shortest code wins.

A context never reaches past a word's first blank, so the code of a word depends on the
word alone, and the different words of some texts are coded together.  A task holds the counts as
arrays, and words only while their texts are read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from annospark.llm.common import crc_mod, held, read, stored

#: Longest context, in bytes.
ORDER = 4
#: Expected labelled documents a language gives to the training sample.
TRAIN_ROWS = 1500
#: (Context, byte) counts that the languages share in equal parts, each its most frequent: bounds the broadcast.
MAX_NODES = 400_000
#: Counts that a language may keep however many languages there are.
LEAST_NODES = 4_000
#: Characters of texts whose words are coded together, and bytes of these at a time.
TOGETHER, STEP = 1 << 19, 1 << 16
#: Posterior, and letters of a text, from which a prediction contradicts a label.
SURE, LETTERS = 0.999, 100
UNKNOWN = "und"

WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, context, byte, n), one row for each of a task's batches."""
    for batch in batches:
        words: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words.update((lang, w) for w in words_of(text.as_py()))
        nodes: Counter = Counter()
        for (lang, word), n in words.items():
            data = b" " + word.encode("utf-8", "replace") + b" "
            for i in range(1, len(data)):
                for k in range(min(ORDER, i) + 1):
                    nodes[lang, data[i - k : i], data[i]] += n
        made = list(nodes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.binary()),
             pa.array([x[2] for x in made], pa.int32()), pa.array(nodes.values(), pa.int64())],
            ["lang", "context", "byte", "n"])


class Trees:
    """The frozen counts of all languages, from a table (lang, context, byte, n): two numbers each.

    A context and its byte are one number, of the bytes behind a leading 1: shifted by a byte it is
    that of the context.
    """

    def __init__(self, table: pa.Table):
        self.name = uuid.uuid4().hex
        self.langs = sorted(table["lang"].unique().to_pylist())
        context = np.fromiter((int.from_bytes(b"\x01" + x.as_py()) for x in table["context"]), np.uint64, len(table))
        windows = context << 8 | table["byte"].to_numpy().astype(np.uint64)
        place = pc.index_in(table["lang"], pa.array(self.langs, pa.string())).to_numpy()
        order = np.lexsort((windows, place))
        ends = np.searchsorted(place[order], np.arange(1, len(self.langs)))
        #: of each language, its windows in order and how often each was seen
        self.counts = list(zip(np.split(windows[order], ends), np.split(table["n"].to_numpy()[order], ends))) if self.langs else []

    @property
    def nodes(self) -> dict[bytes, dict[int, dict[int, int]]]:
        """context -> language -> byte -> n, made anew: to look at, not to code with."""
        out: dict[bytes, dict[int, dict[int, int]]] = {}
        for k, (windows, counts) in enumerate(self.counts):
            for window, n in zip(windows.tolist(), counts.tolist()):
                data = window.to_bytes(ORDER + 2).lstrip(b"\0")[1:]
                out.setdefault(data[:-1], {}).setdefault(k, {})[data[-1]] = n
        return out


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key: str = "doc_id",
          rows: int = TRAIN_ROWS, max_nodes: int = MAX_NODES) -> Trees:
    """Trees from a sample of about ``rows`` documents with text for each language.

    The sample is the documents of the smallest hash of their id, of a whole text each.
    Every language is learned.  Of a language's counts those go that are seen as rarely as
    the first to exceed its share of ``MAX_NODES``, which bounds what the driver sends.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    per = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    shares = stored(per.select("lang", (F.lit(float(rows)) / F.col("n")).alias("share")), "shares")
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    # one row per language, of known size: Spark sends it to the tasks while it is small
    sample = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place")).join(
        shares, "lang").filter("place < share")
    counted = sample.select("lang", "text").mapInArrow(_counts, "lang string, context binary, byte int, n long")
    nodes = stored(counted.groupBy("lang", "context", "byte").agg(F.sum("n").alias("n")), "nodes")
    return Trees(frequent(nodes, max(LEAST_NODES, max_nodes // max(1, shares.count()))).toArrow())


def frequent(nodes: DataFrame, most: int) -> DataFrame:
    """Of (lang, context, byte, n), for each language its most frequent: ``most`` at most, equal ones together.

    The most frequent of a language stay in any case, so that none is lost.
    """
    sizes = nodes.groupBy("lang", "n").agg(F.count("*").alias("size"))
    # a language has few different counts
    falling = Window.partitionBy("lang").orderBy(F.desc("n"))
    ordered = sizes.withColumn("upto", F.sum("size").over(falling)).withColumn("place", F.row_number().over(falling))
    least = ordered.filter((F.col("upto") <= most) | (F.col("place") == 1)).groupBy("lang").agg(F.min("n").alias("least"))
    return nodes.join(least, "lang").filter("n >= least").drop("least")


class Coder:
    """Code lengths of words and texts in all languages.

    Keeps the model only: what it works out for some texts goes with them.
    """

    def __init__(self, trees: Trees):
        self.langs, self.n = trees.langs, len(trees.langs)
        #: of each language: windows and the bits of their last byte, contexts and the bits of leaving them
        self.models = []
        for windows, counts in trees.counts:
            contexts, starts, distinct = np.unique(windows >> 8, return_index=True, return_counts=True)
            total = np.add.reduceat(counts, starts) + distinct
            self.models.append((windows, -np.log2(counts / np.repeat(total, distinct)), contexts, -np.log2(distinct / total)))

    def bits(self, lang: int, windows: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each window after the others."""
        known, cost, contexts, escape = self.models[lang]
        paid, rest, open_ = np.zeros(len(windows)), np.arange(len(windows)), np.ones(len(windows), bool)
        for size in range(ORDER + 1, 0, -1):
            lead = 1 << 8 * size
            now = rest[windows[rest] >= lead]
            tail = windows[now] & (lead - 1) | lead
            at = np.minimum(np.searchsorted(known, tail), len(known) - 1)
            seen = known[at] == tail
            paid[now[seen]] += cost[at[seen]]
            left = np.minimum(np.searchsorted(contexts, tail >> 8), len(contexts) - 1)
            leaves = ~seen & (contexts[left] == tail >> 8)
            paid[now[leaves]] += escape[left[leaves]]
            open_[now[seen]] = False
            rest = rest[open_[rest]]
        paid[rest] += 8.0
        return paid

    def words(self, words: list[str]) -> np.ndarray:
        """Of each word its bits in each language, then its bytes; zeros for one without a letter."""
        alpha = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]
        data = [b" " + w.encode("utf-8", "replace") + b" " if w else b"" for w in alpha]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        starts = np.cumsum(sizes) - sizes
        joined = np.frombuffer(b"".join(data), np.uint8)
        out = np.zeros((len(words), self.n + 1))
        out[:, -1] = np.maximum(sizes - 1, 0)
        for a in range(0, len(joined), STEP):
            at = np.arange(a, min(a + STEP, len(joined)))
            word = np.searchsorted(starts, at, "right") - 1
            before = at - starts[word]
            at, word, before = (x[before > 0] for x in (at, word, before))
            if not len(at):
                continue
            windows = np.uint64(1) << (8 * np.minimum(before, ORDER) + 8).astype(np.uint64)
            for k in range(ORDER + 1):
                windows |= np.where(before >= k, joined[at - np.minimum(before, k)].astype(np.uint64) << 8 * k, 0)
            different, place = np.unique(windows, return_inverse=True)
            for lang in range(self.n):
                sums = np.bincount(word - word[0], self.bits(lang, different)[place])
                out[word[0] : word[0] + len(sums), lang] += sums
        return out

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Of each whole text its bits in each language, then its bytes; each different word is coded once."""
        places: dict[str, int] = defaultdict(count().__next__)
        held_by = [np.array([places[w] for w in words_of(x)], np.int32) for x in texts]
        coded, out = self.words(list(places)), np.zeros((len(texts), self.n + 1))
        for i, held_words in enumerate(held_by):
            different, times = np.unique(held_words, return_counts=True)
            out[i] = (coded[different] * times[:, None]).sum(axis=0)  # row by row, so equal languages tie
        return out

    def code(self, word: str) -> np.ndarray:
        return self.words([word])[0]

    def text(self, text: str | None) -> np.ndarray:
        return self.texts([text])[0]


def decide(langs: list[str], sums: np.ndarray) -> tuple[str, float, float | None]:
    """Language, the posterior of its code among the languages, and bits per byte."""
    size = sums[-1]
    if not size or not langs:
        return UNKNOWN, 0.0, None
    bits = sums[:-1]
    best = int(bits.argmin())
    apart = np.minimum(bits - bits[best], 1000.0)
    return langs[best], float(1.0 / np.exp2(-apart).sum()), float(bits[best] / size)


def together(texts: pa.Array, size: int = TOGETHER) -> Iterator[list[str | None]]:
    """``texts`` in lists of about ``size`` characters, none of them cut."""
    some, n = [], 0
    for x in texts:
        some.append(x.as_py())
        n += len(some[-1] or "")
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def identify(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and bits_per_byte of each whole text.

    A text that is null or has no letter is ``und`` with score 0 and null bits; so is every
    text if nothing could be learned.  Ties go to the first language by name.  Columns of
    ``docs`` of these three names are replaced; every row stays, repeated ones too.

    Only the text goes to Python, and only what is found comes back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    added = T.StructType().add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    kept = [c for c in docs.columns if c not in added.names]

    @F.arrow_udf(added)
    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = held(shared.value.name, lambda: Coder(shared.value))
        for texts in columns:
            rows = [decide(coder.langs, sums) for some in together(texts) for sums in coder.texts(some)]
            lang, score, bits = ([r[k] for r in rows] for k in range(3))
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], added.names)

    made = found(F.col(text_col))
    return docs.select(*kept, *(made[name].alias(name) for name in added.names))


def accepted(docs: DataFrame, trees: Trees, text_col: str = "text", lang_col: str = "lang", sure: float = SURE) -> DataFrame:
    """``docs`` without the texts that have no language, or surely another one than they are said to have.

    No language: no letter, or coded at 8 bits a byte or more, which is what a byte costs without any
    model.  Another one: the posterior of a language that is not the document's own is ``sure`` or
    more, over ``LETTERS`` letters at least.  A null label, or one that was not learned, contradicts nothing; nor does a missing column.
    """
    found = identify(docs.withColumn("_said", F.col(lang_col) if lang_col in docs.columns else F.lit(None)), trees, text_col)
    said = F.col("_said").isin(*trees.langs) if trees.langs else F.lit(False)
    other = said & (F.col("_said") != F.col("lang_pred")) & (F.col("score") >= sure)
    other = F.coalesce(other & (F.length(F.regexp_replace(F.col(text_col), r"\P{L}+", "")) >= LETTERS), F.lit(False))
    return found.filter((F.col("bits_per_byte") < 8) & ~other).select(*docs.columns)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = train(docs.filter(crc_mod("doc_id", 5) != 0))
    found = identify(docs.select("doc_id", "text"), trees)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out"),
                        "lang_pred", "score", "bits_per_byte")
