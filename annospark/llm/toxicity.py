"""Toxicity by a weighted grammar of finite-state transducers.

Each word is read as a symbol: insult, threat, target, denial, report, or another word.  Transducers
are composed and run over each clause that holds an insult or a threat; each reads what the one before
it wrote:

* negation writes a denied insult or threat for one within three words after a denial,
* reported speech writes a quoted one for what follows a verb of saying in its clause,
* insult writes an aimed insult for one after a target, or after another insult: a phrase, not a lone word,
* threat writes an aimed threat for one after a target, or for the target that a threat is followed by,
* score gives each symbol that is left its weight.  A threat at no one hardly counts.

A clause's evidence is the sum over its path; a document's score is the noisy-or of its
clauses, with prior odds that fall as a document grows.  Insults are learned: words and word beginnings that labelled toxic documents use
far more than others, with their log odds as weight.  The other lists are fixed.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from annospark.llm.common import crc_mod, read, stored

# Seed words, in English, German, French and Spanish.
INSULTS = """idiot moron stupid scum loser pathetic worthless disgusting dumb imbecile
idioten dumm dummkopf blödmann abschaum versager widerlich erbärmlich
idiote imbécile stupide crétin connard minable dégoûtant
idiota imbécil estúpido estúpida tonto basura asqueroso patético""".split()
THREATS = """kill hurt destroy strangle murder beat töten umbringen schlagen vernichten
tuer frapper détruire massacrer matar golpear destruir asesinar""".split()
TARGETS = """you your yours yourself he she they him her them du dich dir ihr euch sie er
tu te toi vous il elle ils elles usted ustedes tú ti él ella ellos ellas""".split()
DENIALS = """not never isn't aren't don't won't nicht kein keine niemals
pas jamais aucun nunca jamás tampoco""".split()
REPORTS = """said says wrote reported quoted claimed sagte schrieb berichtete behauptete
dit écrit affirme dijo escribió afirma""".split()

#: Labelled documents, at most about, that the insults are learned from.
TRAIN_ROWS = 40_000
#: Most learned words and beginnings; bounds what is sent to the tasks.
MAX_TERMS = 5_000
#: A term counts as learned from this log-likelihood ratio and these log odds on.
MIN_EVIDENCE, MIN_ODDS = 30.0, 3.5
#: Different words (of 64 kinds) that a learned term must follow, as a share of its toxic
#: documents up to 40: what near copies of one document repeat stands after the same word.
MIN_VARIETY = 0.25
#: Lengths of word beginnings that are tried.
STEMS = range(3, 9)
#: Weight of a fixed insult, which needs company to count, of a threat, and of the target that comes after one.
SEED_WEIGHT, THREAT_WEIGHT, LATE_WEIGHT = 4.3, 5.5, 5.0
#: Log odds of a clause without any evidence.
BIAS = -3.5
#: Words of a document that bears this bias; in a longer one chance matches are likelier, in proportion.
USUAL_WORDS = 300
#: What a clause's probability counts for whose insults and threats an earlier clause has had: it repeats, it does not confirm.
REPEATED = 0.1
PREDICTED = 0.7
KEPT_WORDS = 400_000

WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSES = re.compile(r"[^.!?;:,\n|]+")

OTHER, INSULT, THREAT, TARGET, DENIAL, REPORT = range(6)
#: What transducers write: an insult or threat that is aimed, and either of them denied or quoted.
AIMED_INSULT, AIMED_THREAT, LATE_THREAT, DENIED, QUOTED, DENIED_THREAT, QUOTED_THREAT = range(6, 13)
#: What a symbol counts for, as a share of its word's weight.  That of a lone insult was chosen by training on one of the two
#: folds open to training and testing on the other: 4 false marks, not 7, and 258 found, not 264, of 305.
SHARES = {INSULT: 0.88, AIMED_INSULT: 1.2, AIMED_THREAT: 1.0, LATE_THREAT: 0.0, DENIED: 0.4, QUOTED: 0.7, THREAT: 0.04, DENIED_THREAT: 0.04, QUOTED_THREAT: 0.04}


class Transducer:
    """States and moves; a move reads a symbol and gives a state, a symbol and a weight."""

    def __init__(self, start, move):
        self.start, self.move = start, move

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: ``other`` reads what this one writes; weights multiply."""

        def move(state, symbol):
            a, out, w = self.move(state[0], symbol)
            b, last, v = other.move(state[1], out)
            return (a, b), last, w * v

        return Transducer((self.start, other.start), move)

    def kept(self) -> "Transducer":
        """The same machine, each move worked out once."""
        known: dict = {}

        def move(state, symbol):
            if (state, symbol) not in known:
                known[state, symbol] = self.move(state, symbol)
            return known[state, symbol]

        return Transducer(self.start, move)


def _negation(state, symbol):
    if symbol == DENIAL:
        return 3, symbol, 1.0
    written = {INSULT: DENIED, THREAT: DENIED_THREAT}.get(symbol, symbol) if state else symbol
    return max(0, state - 1), written, 1.0


def _reported(state, symbol):
    if symbol == REPORT:
        return 1, symbol, 1.0
    return state, {INSULT: QUOTED, THREAT: QUOTED_THREAT}.get(symbol, symbol) if state else symbol, 1.0


def _insult(state, symbol):
    """State 1: someone has been named, or something has been called names."""
    if symbol == INSULT:
        return 1, AIMED_INSULT if state else INSULT, 1.0
    return 1 if symbol == TARGET else state, symbol, 1.0


def _threat(state, symbol):
    """State 1: a target has been named; 2: a threat waits for one."""
    if symbol == TARGET:
        return 1, LATE_THREAT if state == 2 else TARGET, 1.0
    if symbol == THREAT:
        return (1, AIMED_THREAT, 1.0) if state == 1 else (2, THREAT, 1.0)
    return state, symbol, 1.0


def _score(state, symbol):
    return state, symbol, SHARES.get(symbol, 0.0)


GRAMMAR = Transducer(0, _negation)
for _next in (_reported, _insult, _threat, _score):
    GRAMMAR = GRAMMAR.then(Transducer(0, _next))


class Lexicon:
    """Symbol and weight of a word: learned words, learned beginnings, fixed lists."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], spared: frozenset[str] = frozenset()):
        self.name = uuid.uuid4().hex
        self.stems, self.spared = stems, spared
        self.words = {w: (INSULT, SEED_WEIGHT) for w in INSULTS}
        for symbol, listed in ((THREAT, THREATS), (TARGET, TARGETS), (DENIAL, DENIALS), (REPORT, REPORTS)):
            self.words |= {w: (symbol, THREAT_WEIGHT if symbol == THREAT else 0.0) for w in listed}
        for w, odds in words.items():
            self.words[w] = (INSULT, max(odds, self.words.get(w, (0, 0.0))[1]))

    def read(self, word: str) -> tuple[int, float]:
        if found := self.words.get(word):
            return found
        if word in self.spared:
            return OTHER, 0.0
        odds = max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k), default=0.0)
        return (INSULT, odds) if odds else (OTHER, 0.0)


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.grammar = lexicon, GRAMMAR.kept()
        self.known: dict[str, tuple[int, float]] = {}

    def read(self, word: str) -> tuple[int, float]:
        if len(self.known) >= KEPT_WORDS:
            self.known.clear()
        found = self.lexicon.read(word)
        if len(word) <= 60:
            self.known[word] = found
        return found

    def clause(self, clause: str) -> float:
        """Evidence, in log odds, of one clause."""
        state, total = self.grammar.start, 0.0
        for word in WORDS.findall(clause):
            symbol, weight = self.known.get(word) or self.read(word)
            state, written, share = self.grammar.move(state, symbol)
            # a target that comes after its threat bears that threat's weight
            total += LATE_WEIGHT if written == LATE_THREAT else share * weight
        return total

    def text(self, text: str | None) -> tuple[float, int]:
        """Score of a whole text and how many of its clauses matched."""
        low = (text or "").lower()
        known, read = self.known, self.read
        words = WORDS.findall(low)
        hot = {w for w in set(words) if (known.get(w) or read(w))[0] in (INSULT, THREAT)}
        clean, matched = 1.0, 0
        if hot:
            had: set[frozenset[str]] = set()
            for m in CLAUSES.finditer(low):
                clause = m[0]
                found = hot.intersection(WORDS.findall(clause))
                if found and (evidence := self.clause(clause)) > 0:
                    matched += 1
                    p = 1.0 / (1.0 + math.exp(-(BIAS + evidence)))
                    clean *= 1.0 - (REPEATED * p if found in had else p)
                    had.add(frozenset(found))
        base = 1.0 / (1.0 + math.exp(-2 * BIAS))
        none = clean * (1.0 - base)
        return (1.0 - none) / (1.0 - none + none * max(1.0, len(words) / USUAL_WORDS)), matched


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (word, toxic documents, other documents, words before it) of each batch."""
    for batch in batches:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        after: dict[str, int] = {}
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = [w for w in WORDS.findall((text.as_py() or "").lower()) if len(w) <= 60]
            seen[toxic].update(set(found))
            if toxic:
                for before, word in zip(["", *found], found):
                    after[word] = after.get(word, 0) | 1 << (zlib.crc32(before.encode("utf-8", "replace")) & 63)
        words = list(seen[0].keys() | seen[1].keys())
        follows = np.array([after.get(w, 0) for w in words], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()),
             pa.array([seen[0][w] for w in words], pa.int64()), pa.array(follows)], ["word", "bad", "good", "after"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    """Insults that the labelled documents teach.

    ``labels``: doc_id, toxic; of several labels of a document the largest counts, null
    labels and ids don't.  Of equal texts one is used, so that a copied document speaks
    once.  The sample, the labels of smallest hash, is bounded by ``rows``, its expected size.
    """
    labels = labels.filter("toxic is not null and doc_id is not null")
    n = labels.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    chosen = labels.filter(place < min(1_000_000, int(1_000_000 * rows / max(n, 1))))
    chosen = chosen.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    # about ``rows`` rows of two numbers
    train_docs = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    train_docs = train_docs.select("toxic", "text").dropDuplicates(["text"])
    words = train_docs.mapInArrow(_uses, "word string, bad long, good long, after long")
    sums = [F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.bit_or("after").alias("after")]
    words = stored(words.groupBy("word").agg(*sums), "words")
    stems = words.filter(F.length("word") >= STEMS[0]).select(
        "word", "bad", "good", "after", F.explode(F.sequence(F.lit(STEMS[0]), F.least(F.length("word"), F.lit(STEMS[-1])))).alias("k"))
    stems = stems.groupBy(F.expr("substring(word, 1, k)").alias("term")).agg(*sums)
    terms = words.select(F.col("word").alias("term"), "bad", "good", "after", F.lit(True).alias("whole")).unionByName(
        stems.withColumn("whole", F.lit(False)))
    # the prior of a word use, not of a document: toxic documents may be longer than others
    totals = words.agg(F.sum("bad"), F.sum("good")).first()
    bad, good = float(totals[0] or 0) + 1.0, float(totals[1] or 0) + 1.0
    share = bad / (bad + good)
    n_, b_ = F.col("bad") + F.col("good"), F.col("bad")
    gain = 2 * (b_ * F.log(b_ / (n_ * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n_ * (1 - share)))).otherwise(0.0))
    odds = F.log((b_ + 0.5) / (F.col("good") + 0.5)) - math.log(bad / good)
    strong = terms.filter("bad > 0").select("term", "whole", gain.alias("gain"), odds.alias("odds"), "bad", "good", "after").filter(
        (F.col("gain") >= MIN_EVIDENCE) & (F.col("odds") >= MIN_ODDS) & (F.bit_count("after") >= MIN_VARIETY * F.least("bad", F.lit(40))))
    top = strong.orderBy(F.desc("gain"), "term", "whole").limit(MAX_TERMS).collect()
    learned = {r.term: min(r.odds, 7.0) for r in top if not r.whole}
    # words that begin like an insult, but that clean documents use as much
    begins = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in learned], "term string"))
    spared = words.filter("good >= 2 and good >= bad").select(
        "word", "good", F.explode(F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[-1])), lambda k: F.substring("word", 1, k))).alias("term"))
    spared = spared.join(begins, "term", "left_semi").groupBy("word").agg(F.max("good").alias("good"))
    spared = spared.orderBy(F.desc("good"), "word").limit(MAX_TERMS).collect()
    return Lexicon({r.term: min(r.odds, 7.0) for r in top if r.whole}, learned, frozenset(r.word for r in spared))


_MADE: dict[str, Scorer] = {}


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, matched_clauses) for each row of ``docs``, over its whole text.

    Null and empty texts get the score of no evidence.  Every row counts, repeated ones and
    those without id too; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = shared.value.name
        if name not in _MADE:
            _MADE.clear()
            _MADE[name] = Scorer(shared.value)
        for batch in batches:
            found = [_MADE[name].text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())],
                ["doc_id", "score", "matched_clauses"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, score double, matched_clauses long")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1)
    found = score(docs, train(docs, labels))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= PREDICTED).cast("int").alias("predicted"), "matched_clauses")
