"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the pairs of neighbouring symbols, each with its merge rank and
place.  The root is the smallest of them, hence the leftmost pair of the lowest rank.  A
merge changes three leaves; each change climbs to the root in logarithmic time.  It ends
when the root holds no pair that merges, so a word of n symbols takes n log n steps, also
when it is a whole text without a space.

The vocabulary is a file of the tokenizers library whose path is a parameter; it is read
once per task from the executor's own installation.  The format understood: a BPE model
with end-of-word suffix over byte-level symbols, NFC, lower case, white space dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from annospark.llm.common import held, read

NONE = 1 << 200
#: Words whose tokens a task keeps; it starts anew when that many are known.
KEPT_WORDS = 400_000

# White space and the word pattern that the vocabulary was made with.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

WORDS = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def _latin_words() -> re.Pattern:
    """``WORDS`` for texts of Latin-1 letters, in the faster of the two engines."""
    of = lambda kind: "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] == kind)
    letters, numbers = of("L"), of("N")
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


LATIN_WORDS = _latin_words()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def lowered(text: str) -> str:
    """Lower case letter by letter, blind to the letters around (Greek final sigma)."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """``ids`` after all merges; ``pairs``: first << 20 | second -> rank << 20 | merged."""
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 2).bit_length()
    tree = [NONE] * (2 * size)
    get = pairs.get
    for i in range(n - 1):
        rank = get(ids[i] << 20 | ids[i + 1])
        if rank is not None:
            tree[size + i] = rank << 40 | i
    for i in range(size - 1, 0, -1):
        x, y = tree[2 * i], tree[2 * i + 1]
        tree[i] = x if x < y else y
    after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            x, y = tree[2 * i], tree[2 * i + 1]
            if x > y:
                x = y
            if tree[i] == x:
                return
            tree[i] = x

    while (top := tree[1]) != NONE:
        i = top & (1 << 40) - 1
        ids[i] = new = top >> 40 & (1 << 20) - 1
        j = after[i]
        k = after[i] = after[j]
        ids[j] = -1
        if j < n - 1:
            put(j, NONE)
        rank = None
        if k < n:
            ahead[k] = i
            rank = get(new << 20 | ids[k])
        put(i, NONE if rank is None else rank << 40 | i)
        if (h := ahead[i]) >= 0:
            rank = get(ids[h] << 20 | new)
            put(h, NONE if rank is None else rank << 40 | h)
    return [x for x in ids if x >= 0]


class Bpe:
    """Encodes and decodes with the vocabulary file at ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[x] << 20 | vocab[y], rank << 20 | vocab[x + y])
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + end) for s in symbols]
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.shown = {str(i): t for i, t in self.token.items()}
        self.known: dict[str, str] = {}

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return merge([i for i in ids if i is not None], self.pairs)

    def spelled(self, word: str) -> str:
        """The ids of a word, joined by spaces; those of short words are kept."""
        made = " ".join(map(str, self.word(word)))
        if len(word) <= 40:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = made
        return made

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return LATIN_WORDS.findall(text.lower())
        except UnicodeEncodeError:
            return WORDS.findall(lowered(unicodedata.normalize("NFC", text)))

    def encoded(self, text: str | None) -> str:
        """Ids of a text, joined by one space."""
        known, spelled, ids = self.known, self.spelled, []
        parts = self.cut.split(text or "") if self.cut and "<|" in (text or "") else [text or ""]
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(str(self.special[part]))
            else:
                ids += [known.get(w) or spelled(w) for w in self.words(part)]
        return " ".join(filter(None, ids))

    def ids(self, text: str | None) -> list[int]:
        return [int(x) for x in self.encoded(text).split()]

    def decoded(self, ids: str) -> str:
        """The tokens of ids joined by spaces, one space between, as the vocabulary names no other decoder."""
        shown = self.shown
        return " ".join([shown[i] for i in ids.split() if i in shown])

    def decode(self, ids: list[int]) -> str:
        return self.decoded(" ".join(map(str, ids)))


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def tokenizer(path: str | None) -> Bpe:
    """One for each worker process; without a path, the one of the worker's installation."""
    path = path or vocabulary_path()
    return held(path, lambda: Bpe(path))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row; null and empty texts have no tokens."""
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = pa.array([bpe.ids(x.as_py()) for x in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(*columns).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) for each row (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = pa.array([bpe.decode(x.as_py() or []) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(
        run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row, ids and text digested where they are made.

    Encodes each whole text and decodes its ids.  Null and empty texts have no tokens and
    decode to the empty text.  Repeated rows give a row each, null ids stay null, other
    columns are ignored; an empty table gives none.
    """

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for x in batch.column(1):
                ids = bpe.encoded(x.as_py())
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(digest(ids))
                text_sha.append(digest(bpe.decoded(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
