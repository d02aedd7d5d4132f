"""Near copies: SimHash blocks and Hamming check for candidates, exact Jaccard of word shingles to decide.

Texts of the same set of five-word shingles are one class.  Each class has a SimHash of 192 bits
over its shingles and, of as many further bits as needed, blocks of ten bits.  At similarity 0.8
two classes differ in a bit with a chance of acos(0.889) / pi = 0.152 (0.19 for sets of five
shingles).  They agree on none of 64 blocks with probability (1 - 0.848 ** 10) ** 64, or 2 in a
million, and are more than 54 of 192 bits apart in 2 of a million cases (8 of ten thousand at 0.19),
unrelated ones at most that far in 6 of 10 ** 10.  (With 38 of 128 bits it was 3 of a million: chance
candidates, whose texts are read, grew with the square of the table.)  Inside a bucket of one block the
Hamming distance decides; what it connects is a cluster.  A bucket of more than ``WHOLE`` classes is first split by eight further bits, in eight ways.

Only numbers travel until clusters are known.  In a cluster each class is compared with the
smallest one, its leader; a leader's many pairs are shared out and each pair compared once, whatever
the clusters it meets in.  Clusters whose classes these links connect are done.  In one that is not, and
has at most ``CROWD`` classes, all that may be near are compared, so that no connection is lost.  The
classes of larger ones are dealt anew by 300 blocks of twenty bits, with the same argument.

The module's name is older than its method: keys of several minima were the first one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from annospark.llm.common import marks, stored, struck
from annospark.llm.simhash import components, wide

SHINGLE = 5
LEAST = 0.8
#: Blocks and bits of each, first for all classes, then for those of crowded clusters.
LEVELS = ((64, 10), (300, 20))
#: Longs of a SimHash, and bits of them in which candidates may differ.
LONGS, APART = 3, 54
#: Classes of a bucket that are held against each other; ways to split a larger one, bits of each, and how often.
WHOLE, WAYS, SPLIT, DEPTH = 256, 8, 8, 2
#: Classes of a cluster that may all be compared, and pairs of one leader in a task.
CROWD, SHARE = 1000, 128
SEED = 5
#: Columns of the SimHash.
PRINT = [f"f{k}" for k in range(LONGS)]
LONG_PRINT = ", ".join(f"{f} long" for f in PRINT)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different XXH64 values of the word shingles; one for all words where there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    runs = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, runs)), dtype="<u8"))


def blocks(held: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The longs of a set's SimHash and the keys of its blocks; no keys for the empty set."""
    n, size = LEVELS[level]
    if not len(held):
        return np.zeros(LONGS, dtype=np.int64), np.zeros(0, dtype=np.int64)
    bits, own = wide(held, LONGS + -(-n * size // 64), level), 64 * LONGS
    values = bits[own : own + n * size].reshape(n, size) @ (1 << np.arange(size, dtype=np.int64))
    return np.packbits(bits[:own]).view(np.int64), (np.arange(n, dtype=np.int64) << size) + values


def _stars(near: np.ndarray) -> list[tuple[int, int]]:
    """(place, root) for the connected places of a table of 0 and 1."""
    left, out = near.sum(axis=1) > 1, []
    for root in np.flatnonzero(left):
        if left[root]:
            left[root], front = False, np.array([root])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & left)
                left[front] = False
                out += [(int(i), int(root)) for i in front]
    return out


def hamming(prints: np.ndarray, whole: int = WHOLE) -> list[tuple[int, int]]:
    """Links (place, place of a root) that connect the rows (unsigned longs) at most ``APART`` bits apart.

    Rows of fewer longs than ``LONGS`` may differ in the same share of their bits.  Up to ``whole`` rows
    all are compared; more are split by bits first, as often as ``DEPTH``, and what is still together then
    is searched from one row to the next.
    """
    rng, out, longs = np.random.default_rng(SEED), [], prints.shape[1]
    most = APART * longs // LONGS

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.zeros((len(a), len(b)), dtype=np.uint8)  # at most 192: a byte holds it
        for k in range(longs):
            both += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
        return both

    def searched(at: np.ndarray) -> None:
        left = at
        while len(left):
            root, front, left = left[0], left[:1], left[1:]
            while len(front) and len(left):
                near = np.zeros(len(left), dtype=bool)
                for k in range(0, len(front), 64):
                    open_ = np.flatnonzero(~near)
                    near[open_] = (apart(prints[front[k : k + 64]], prints[left[open_]]) <= most).any(axis=0)
                front, left = left[near], left[~near]
                out.extend((int(i), int(root)) for i in front)

    def split(at: np.ndarray, depth: int) -> None:
        if len(at) <= whole:
            near = apart(prints[at], prints[at]) <= most
            if near.sum() > len(at):
                out.extend((int(at[i]), int(at[j])) for i, j in _stars(near))
            return
        if depth == DEPTH:
            searched(at)
            return
        for _ in range(WAYS):
            value = np.zeros(len(at), dtype=np.uint64)
            for bit in rng.choice(64 * longs, SPLIT, replace=False).tolist():
                value = value << np.uint64(1) | prints[at, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            for part in np.split(at[order], cuts):
                if len(part) > 1:
                    split(part, depth + 1)

    split(np.arange(len(prints)), 0)
    return out


def _signed(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))


def _columns(prints: list[np.ndarray]) -> list[pa.Array]:
    table = np.array(prints, dtype=np.int64).reshape(-1, LONGS)
    return [pa.array(table[:, k]) for k in range(LONGS)]


def _version():
    return F.xxhash64(F.col("text").cast("string"))


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, version, kind, *PRINT, keys): what each row's text is known by."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, prints, keys = [], [], []
            for x in batch.column(2):
                held = shingles(x.as_py())
                kinds.append(xxhash.xxh64_intdigest(held.tobytes()))
                own, found = blocks(held)
                prints.append(own)
                keys.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _signed(kinds), *_columns(prints), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "version", "kind", *PRINT, "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _version().alias("version"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(mark, f"doc_id long, version long, kind long, {LONG_PRINT}, keys array<long>")


def _clusters(rows: DataFrame) -> DataFrame:
    """(key, kind): classes that the Hamming distance connects inside a bucket of ``rows`` (key, kind, *PRINT).

    The same cluster of several buckets has the same key and comes once.
    """
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def found(table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            if len(table) < 2:
                return
            root = np.arange(len(table))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            links_ = hamming(table[:, 1:].view(np.uint64))
            for i, j in links_:
                root[top(i)] = top(j)
            members: dict[int, set[int]] = {}
            for i in {i for x in links_ for i in x}:
                members.setdefault(int(top(i)), set()).add(int(table[i, 0]))
            for kinds in members.values():
                own = np.sort(np.fromiter(kinds, dtype=np.int64, count=len(kinds)))
                yield xxhash.xxh64_intdigest(own.tobytes()), own

        def made(clusters: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            sizes = [len(x) for _, x in clusters]
            keys = np.repeat(np.array([k for k, _ in clusters], dtype=np.uint64).view(np.int64), sizes)
            kinds = np.concatenate([x for _, x in clusters]) if clusters else np.zeros(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(kinds)], ["key", "kind"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            table = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 2 + LONGS)], axis=1)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            out: list[tuple[int, np.ndarray]] = []
            for start, part in zip([0, *cuts.tolist()], np.split(table, cuts)):
                if keys[start] != key:
                    if held:
                        out.extend(found(np.concatenate(held)))
                    key, held = keys[start], []
                held.append(part)
            yield made(out)
        if held:
            yield made([*found(np.concatenate(held))])

    dealt = rows.select("key", "kind", *PRINT).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(link, "key long, kind long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kind, held): the shingles of the classes of ``wanted`` (kind, version), read from one of their texts."""
    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingles(x.as_py()).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["kind", "held"])

    versions = wanted.select("version")
    rows = docs.select(_version().alias("version"), F.col("text").cast("string").alias("text"))
    few = struck(rows, "version", marks(versions, "version")).filter("_struck").drop("_struck")
    # a kind has one version: by both, the rows stay where the join has dealt them
    texts = few.join(wanted, "version").dropDuplicates(["version", "kind"]).select("kind", "text")
    return texts.mapInArrow(hold, "kind long, held binary")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, near) for the pairs (a, b): is their similarity ``LEAST`` or more?

    The set of ``a`` is sent once for every ``SHARE`` of its pairs and held while these pass by.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = np.zeros(0, dtype="<u8")
        for batch in batches:
            a, b, near = [], [], []
            held = batch.column(4)
            for i, (x, turn, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                own = np.frombuffer(held[i].as_buffer(), dtype="<u8")
                if not turn:
                    leader = own.copy()  # not a view of a batch that goes
                    continue
                both = len(np.intersect1d(leader, own, assume_unique=True))
                a.append(x), b.append(y), near.append(both >= LEAST * (len(leader) + len(own) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(near, pa.bool_())], ["a", "b", "near"])

    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")
    members = pairs.join(counts, "a").select("a", share.alias("share"), F.lit(1).alias("turn"), "b")
    leaders = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("turn"), F.col("a").alias("b"))
    rows = members.unionByName(leaders).join(sets.withColumnRenamed("kind", "b"), "b").select("a", "share", "turn", "b", "held")
    dealt = rows.repartition("a", "share").sortWithinPartitions("a", "share", "turn")
    return dealt.mapInArrow(compare, "a long, b long, near boolean")


def forest(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links (place, place of a root) that connect the sets of at least this similarity."""
    sizes = np.array([len(x) for x in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(names), dtype=np.int64)

    def near(x: int, others: np.ndarray) -> np.ndarray:
        mark[parts[x]] = 1
        joined, starts = np.concatenate([parts[i] for i in others]), np.r_[0, np.cumsum(sizes[others])[:-1]]
        both = np.add.reduceat(mark[joined], starts)
        mark[parts[x]] = 0
        return both >= least * (sizes[x] + sizes[others] - both) - 1e-9

    left, out = np.arange(len(sets)), []
    while len(left):
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            hit = near(front.pop(), left)
            front += left[hit].tolist()
            out += [(int(i), int(root)) for i in left[hit]]
            left = left[~hit]
    return out


def _within(inside: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect the near classes of each bucket (key, b); a task holds one bucket at a time."""
    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kinds, sets_ = None, [], []

        def made() -> pa.RecordBatch:
            found = forest(sets_) if len(sets_) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([kinds[i] for i, _ in found], pa.int64()), pa.array([kinds[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            held = batch.column(2)
            for i, (k, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if k != key:
                    yield made()
                    key, kinds, sets_ = k, [], []
                kinds.append(kind)
                sets_.append(np.frombuffer(held[i].as_buffer(), dtype="<u8").copy())
        yield made()

    rows = inside.select("key", "b").join(sets.withColumnRenamed("kind", "b"), "b").select("key", "b", "held")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(connect, "a long, b long")


def _again(members: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """(kind, *PRINT, key): classes of crowded clusters, each once, dealt by the blocks of the next level."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(np.frombuffer(x.as_buffer(), dtype="<u8"), level) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *_columns([p for p, _ in found]), pa.array([k for _, k in found], pa.list_(pa.int64()))],
                ["kind", *PRINT, "keys"])

    rows = members.select(F.col("b").alias("kind")).distinct().join(sets, "kind").select("kind", "held")
    return rows.mapInArrow(deal, f"kind long, {LONG_PRINT}, keys array<long>").select("kind", *PRINT, F.explode("keys").alias("key"))


def links(docs: DataFrame, kinds: DataFrame, crowd: int = CROWD) -> DataFrame | None:
    """Links (a, b) between classes that connect all which are near; None without candidates.

    kinds: (kind, version, *PRINT, keys).  ``docs`` is read once more, for the texts of candidates.
    """
    rows, found, sets = kinds.select("kind", *PRINT, F.explode("keys").alias("key")), None, None
    for level in range(len(LEVELS)):
        rows = stored(_clusters(rows), "clusters")
        buckets = rows.groupBy("key").agg(F.min("kind").alias("a"), F.count("*").alias("many"))
        buckets = stored(buckets, "buckets")
        held = stored(rows.join(buckets, "key").select("key", "a", "many", F.col("kind").alias("b")), "members")
        if held.isEmpty():
            break
        if sets is None:
            wanted = held.select(F.col("b").alias("kind")).distinct().join(kinds.select("kind", "version"), "kind")
            sets = stored(_sets(docs, stored(wanted, "wanted")), "sets")
        first = stored(_compared(held.filter("a <> b").select("a", "b").distinct(), sets), "compared")
        near = first.filter("near").select("a", "b")
        found = near if found is None else found.unionByName(near)
        apart = held.join(first.filter("not near").select("a", "b"), ["a", "b"])
        apart = stored(apart.select("key", "a", "many", F.col("b").alias("odd")), "apart")
        if apart.isEmpty():
            break
        # what is connected by now needs no further link: only pairs across components are compared
        roots = components(stored(found.distinct(), "so-far")).select(F.col("a").alias("b"), "root")
        inside = held.join(apart.select("key").distinct(), "key", "left_semi").join(roots, "b", "left")
        inside = stored(inside.select("key", "many", "b", F.coalesce("root", "b").alias("root")), "inside")
        mixed = inside.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        inside = stored(inside.join(mixed.select("key"), "key", "left_semi"), "mixed")
        if inside.isEmpty():
            break
        found = found.unionByName(stored(_within(inside.filter(F.col("many") <= crowd), sets), "within"))
        rest = inside.filter(F.col("many") > crowd)
        if level + 1 < len(LEVELS):
            rows = _again(rest, sets, level + 1)
            continue
        # crowded by equal blocks of twenty bits and yet not connected: pair by pair
        named = rest.select("key", F.col("b").alias("odd"), F.col("root").alias("own"))
        odd = apart.select("key", "odd").join(named, ["key", "odd"])
        pairs = rest.select("key", "b", "root").join(odd, "key").filter("root <> own")
        pairs = pairs.select(F.least("odd", "b").alias("a"), F.greatest("odd", "b").alias("b")).distinct()
        found = found.unionByName(stored(_compared(pairs, sets), "compared").filter("near").select("a", "b"))
    return found


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group connected by near copies, the one of smallest id.

    Texts without words are one group.  Of repeated ids one row stays.  Rows without id go where
    their group has a document with one; otherwise one of them stays.  Rows that surely stay are
    passed on where they are read; only those that a table of marks strikes are joined.
    """
    marked = stored(_marked(docs), "simhash")
    kinds = stored(marked.groupBy("kind").agg(F.min("doc_id").alias("least"), F.min("version").alias("version"),
                                               *(F.first(f).alias(f) for f in PRINT), F.first("keys").alias("keys")), "kinds")
    found = links(docs, kinds)
    own = kinds.select("kind", "least", "version")
    if found is None:
        rooted = own.select("least", "version", F.col("kind").alias("root"))
    else:
        roots = components(stored(found.distinct(), "copies")).withColumnRenamed("a", "kind")
        rooted = own.join(roots, "kind", "left").select("least", "version", F.coalesce("root", "kind").alias("root"))
    groups = stored(rooted.groupBy("root").agg(F.min("least").alias("least"), F.min("version").alias("version")), "groups")

    kept = groups.filter("least is not null").select(F.col("least").alias("doc_id"), F.lit(True).alias("_stays"))
    ids = marked.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).join(kept, "doc_id", "left")
    unsure = stored(ids.filter("_stays is null or n > 1").select("doc_id", F.coalesce("_stays", F.lit(False)).alias("_stays")), "unsure")
    rows = struck(docs, "doc_id", marks(unsure, "doc_id"))
    sure = rows.filter("doc_id is not null and not _struck").select(*docs.columns)
    judged = rows.filter("doc_id is not null and _struck").join(unsure, "doc_id", "left").filter("coalesce(_stays, true)")
    named = sure.unionByName(judged.dropDuplicates(["doc_id"]).select(*docs.columns))
    bare = docs.filter("doc_id is null")
    if bare.isEmpty():
        return named
    loose = groups.filter("least is null").select(F.col("version").alias("_version"))
    bare = bare.withColumn("_version", _version()).join(loose, "_version", "left_semi").dropDuplicates(["_version"])
    return named.unionByName(bare.select(*docs.columns))
