"""Personal data: patterns, and what the corpus says gives an entity away.

Four patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers.
Then co-occurrence over the whole corpus estimates how much one thing tells of another.
Different texts are counted, so that exact copies are one witness:

    PMI(t, e) = log2(n(t, e) * N / (n(t) * n(e))),    disclosure(t, e) = n(t, e) / n(t)

*Terms.*  n(t, e) counts texts in which the word t (a run of two letters or more) stands in
a line with the entity e, at most ``CONTEXT`` code points away; n(t) those that hold t at
all.  A term in ``MIN_DOCS`` texts with ``MIN_PMI`` bits and ``MIN_DISCLOSURE`` is a span
of kind ``term`` in the texts that name the entity.

*Secrets.*  A token of 16 or more letters and digits that carries ``MIN_BITS`` by the
frequencies of its own characters may be one.  What is protected here is the class of such
tokens; a cue is the word before one with the signs between them (``token = "``).  A cue
that discloses the class as above, with ``MIN_CUE_BITS`` of PMI (a class is commoner than
one entity), makes the tokens after it secrets, wherever else they stand too.

``sanitised`` writes the kind in place of each span.

DataFrame functions only.  Patterns are written so that Java's matcher takes linear time
and no deep recursion: separators inside a match are first turned into one marker of
the same length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annospark.functions.binding import let
from annospark.llm.common import marks, read, stored, struck

#: Code points to either side of an entity, within its line, in which its terms are sought.
CONTEXT = 512
MIN_DOCS = 3
MIN_DISCLOSURE = 0.9
MIN_PMI = 6.0
MIN_CUE_BITS = 3.0
MIN_BITS = 48.0
#: Matches between two checkpoints of the running sum of lengths.
BLOCK = 256

DOT, GAP = "\ue000", "\ue001"
KINDS = ("email", "ip", "card", "phone")
ADDED = ("term", "secret")

#: Signs that may not touch a term: it would be part of an address or a name in code.
_BEFORE, _AFTER = r"(?<![\p{L}\p{M}\p{N}@_]|[\p{L}\p{N}]\.)", r"(?![\p{L}\p{M}\p{N}@_]|\.[\p{L}\p{N}])"
_CUT = r"[\p{L}\p{M}\p{N}@_.]++"
TERM = _BEFORE + r"\p{L}{2,}+" + _AFTER
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9][A-Za-z0-9_+/-]{15,}+={0,2}"
CUE = r"(?<!\p{L})\p{L}++[^\p{L}\p{N}\n]{1,8}"

_LOCAL = rf"A-Za-z0-9._%+\-{DOT}"
PATTERNS = {
    # a match begins where the last one ended or where no earlier letter could begin it
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9{GAP}]{{13,}}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def _prepared(kind: str) -> Column:
    """The text in which a kind is searched, of the same length; null where there can be none."""
    # the markers stand for no sign of a text: where it has them, they become one that is in no pattern
    plain = F.translate("text", DOT + GAP, "\t\t")
    if kind == "email":
        marked = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
        return F.when(F.contains(F.col("text"), F.lit("@")), marked)
    if kind == "ip":
        return F.when(F.col("text").rlike(r"[0-9]\.[0-9]"), plain)
    if kind == "card":
        return F.when(F.col("text").rlike(r"[0-9][ -]?[0-9]"), F.regexp_replace(plain, r"(?<=[0-9])[ -](?=[0-9])", GAP))
    return F.when(F.contains(F.col("text"), F.lit("+")), plain)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, 1).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _holds(kind, s["value"])


def _mark(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), F.lit(f"[{kind.upper()}]").alias("kind"))


def located(text: Column, pattern: Column) -> Column:
    """Array of (start, end, value, left, right) of the matches, in order, in code points.

    The text between matches gives their places; sums run in blocks, so that a text
    of very many matches stays near linear.
    """
    def place(parts: Column) -> Column:
        pieces, values = parts["pieces"], parts["values"]
        steps = F.zip_with(F.slice(pieces, 1, F.size(values)), values, lambda p, v: F.length(p) + F.length(v))

        def total(a: Column) -> Column:
            return F.aggregate(a, F.lit(0), lambda s, x: s + x)

        def blocks(own: Column) -> Column:
            starts = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int"))
            return F.transform(starts, lambda b: total(F.slice(own, b * BLOCK + 1, F.lit(BLOCK))))

        def spans(own: Column) -> Column:
            def span(bases: Column) -> Column:
                def at(v: Column, i: Column) -> Column:
                    block = F.floor(i / BLOCK).cast("int")
                    before = F.get(bases, block) + total(F.slice(own, block * BLOCK + 1, i % BLOCK))
                    return let(before + F.length(F.get(pieces, i)), lambda start: F.struct(
                        start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"),
                        F.substring(F.get(pieces, i), -CONTEXT, CONTEXT).alias("left"),
                        F.substring(F.get(pieces, i + 1), 1, CONTEXT).alias("right")))

                return F.transform(values, at)

            sums = blocks(own)
            bases = let(sums, lambda s: F.transform(s, lambda x, i: total(F.slice(s, F.lit(1), i))))
            return let(bases, span)

        return let(steps, spans)

    values = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.when(F.size(values) > 0, let(F.struct(F.split(text, pattern, -1).alias("pieces"), values.alias("values")), place))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with an array of checked spans for each kind; null where there is none."""
    out = docs
    for kind in KINDS:
        found = located(_prepared(kind), F.lit(PATTERNS[kind]))
        out = out.withColumn(kind, F.filter(found, _check(kind)))
    return out


def _listed(kind: str) -> Column:
    return F.coalesce(F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])), F.array().cast("array<string>"))


def entropy(value: Column) -> Column:
    """Bits that a string carries by the frequencies of its own characters."""
    def over(chars: Column) -> Column:
        def part(total: Column, c: Column) -> Column:
            n = F.size(F.filter(chars, lambda x: x == c))
            return total - n * F.log2(n / F.size(chars))

        return F.aggregate(F.array_distinct(chars), F.lit(0.0), part)

    return let(F.split(value, ""), over)


def _secretive(s: Column) -> Column:
    return s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (entropy(s["value"]) >= MIN_BITS)


def _one_blank(cue: Column) -> Column:
    return F.regexp_replace(F.lower(cue), r"\s+", " ")


def _cued(text: Column, spans: Column) -> Column:
    """``spans`` as (start, end, value, cue); null where there is none.

    The cue is sought in the text itself: its word may be the end of another token, as in
    ``aws_secret_access_key = ``.  Parts of one length give it, so many spans stay linear.
    """
    def found(some: Column) -> Column:
        def within(parts: Column) -> Column:
            def cued(s: Column) -> Column:
                part = F.floor(s["start"] / CONTEXT).cast("int")
                left = F.concat(F.coalesce(F.get(parts, part - 1), F.lit("")), F.substring(F.get(parts, part), F.lit(1), s["start"] % CONTEXT))
                return F.struct(s["start"], s["end"], s["value"], F.regexp_extract(left, CUE + "$", 0).alias("cue"))

            return F.transform(some, cued)

        return F.when(F.size(some) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CONTEXT}}}+"), F.lit(0)), within))

    return let(spans, found)


def found_in(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text, email, ip, card, phone, secret), secret being candidates yet, with their cues.

    version is the SHA-256 of the text (of an empty one for null).  text is null where
    nothing was found: what follows never moves the text of other documents.
    """
    text = F.col("text").cast("string")
    rows = base_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")))
    candidates = _cued(F.col("text"), F.filter(located(F.col("text"), F.lit(SECRET)), _secretive))
    rows = rows.withColumn("secret", F.when(F.col("text").rlike("[A-Za-z0-9_+/-]{16}"), candidates))
    some = F.lit(False)
    for kind in (*KINDS, "secret"):
        some = some | (F.coalesce(F.size(kind), F.lit(0)) > 0)
    return rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("version"),
                       F.when(some, F.col("text")).alias("text"), *KINDS, "secret")


def _different(docs: DataFrame) -> DataFrame:
    """(text): each different text once; only texts that come again are moved."""
    rows = docs.select(F.xxhash64("text").alias("version"), "text")
    again = rows.groupBy("version").agg(F.count("*").alias("n")).filter("n > 1").select("version")
    rows = struck(rows, "version", marks(again, "version"))
    few = stored(rows.filter("_struck").dropDuplicates(["version"]).select("text"), "again")
    return rows.filter("not _struck").select("text").unionByName(few)


def _counted(docs: DataFrame, pattern: str, wanted: DataFrame, key: str, cleaned=F.lower) -> DataFrame:
    """(key, in_all): different texts that hold a match of ``pattern``, of those in ``wanted``.

    Counted where the texts are, for all matches, and met with ``wanted`` after that: rows by text never travel.
    """
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), cleaned))
    held = _different(docs).select(F.explode(words).alias(key)).groupBy(key).agg(F.count("*").alias("in_all"))
    # keys of wanted come once; a semi join would be pushed below the counts and meet every match
    return held.join(wanted, key)


def _scored(pairs: DataFrame, total: int, with_entity: Column, min_docs: int, min_disclosure: float, min_pmi: float) -> DataFrame:
    """``pairs`` (both, in_all) with pmi and disclosure, those over the thresholds."""
    scored = pairs.withColumn("pmi", F.log2(F.col("both") * float(total) / (F.col("in_all") * with_entity)))
    scored = scored.withColumn("disclosure", F.col("both") / F.col("in_all"))
    return scored.filter((F.col("both") >= min_docs) & (F.col("pmi") >= min_pmi) & (F.col("disclosure") >= min_disclosure))


def disclosing(mentions: DataFrame, docs: DataFrame, total: int, min_docs: int = MIN_DOCS,
               min_disclosure: float = MIN_DISCLOSURE, min_pmi: float = MIN_PMI) -> DataFrame:
    """(entity, term, pmi, disclosure) of the terms over the thresholds.

    mentions: (version, entity, left, right); docs: (text); total: different texts in docs.
    """
    # a word that the window cuts is none
    left = F.when(F.length("left") == CONTEXT, F.regexp_replace("left", "^" + _CUT, "")).otherwise(F.col("left"))
    right = F.when(F.length("right") == CONTEXT, F.regexp_replace("right", "(?<!" + _CUT[:-2] + ")" + _CUT + "$", "")).otherwise(F.col("right"))
    left, right = F.substring_index(left, "\n", -1), F.substring_index(right, "\n", 1)
    # the entity itself stands between: a sign in its place keeps both ends what they are
    near = F.concat(F.regexp_extract_all(F.concat(left, F.lit("@")), F.lit(TERM), F.lit(0)),
                    F.regexp_extract_all(F.concat(F.lit("@"), right), F.lit(TERM), F.lit(0)))
    near = F.array_distinct(F.transform(near, F.lower))
    named = mentions.select("version", "entity").distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    # an entity of fewer texts shares no term with enough of them
    often = stored(named.filter(F.col("with_entity") >= min_docs), "entities")
    pairs = mentions.join(often.select("entity"), "entity", "left_semi").select("version", "entity", F.explode(near).alias("term")).distinct()
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= min_docs)
    pairs = stored(pairs, "pairs")
    in_all = _counted(docs, TERM, stored(pairs.select("term").distinct(), "terms"), "term")
    pairs = pairs.join(in_all, "term").join(often, "entity")
    return _scored(pairs, total, F.col("with_entity"), min_docs, min_disclosure, min_pmi).select("entity", "term", "pmi", "disclosure")


def cues(candidates: DataFrame, docs: DataFrame, total: int, min_docs: int = MIN_DOCS,
         min_disclosure: float = MIN_DISCLOSURE, min_pmi: float = MIN_CUE_BITS) -> DataFrame:
    """(cue, pmi, disclosure) of the cues after which a secret follows.

    candidates: (version, value, cue).  Besides texts, ``min_docs`` different values must follow.
    """
    seen = candidates.filter("cue != ''").groupBy("cue", "version", "value").agg(F.lit(1).alias("one"))
    values = seen.select("cue", "value").distinct().groupBy("cue").agg(F.count("*").alias("values")).filter(F.col("values") >= min_docs)
    both = seen.select("cue", "version").distinct().groupBy("cue").agg(F.count("*").alias("both")).join(values, "cue")
    both = stored(both, "cues")
    of_class = candidates.select("version").distinct().count()
    in_all = _counted(docs, CUE + r"(?=[A-Za-z0-9])", stored(both.select("cue"), "wanted"), "cue", _one_blank)
    return _scored(both.join(in_all, "cue"), total, F.lit(of_class), min_docs, min_disclosure, min_pmi).select("cue", "pmi", "disclosure")


def personal_data(docs: DataFrame, min_docs: int = MIN_DOCS, min_disclosure: float = MIN_DISCLOSURE,
                  min_pmi: float = MIN_PMI, min_cue_bits: float = MIN_CUE_BITS) -> DataFrame:
    """(doc_id, version, text, email, ip, card, phone, term, secret) for each row: arrays of spans by kind.

    Null and empty texts have none.  Repeated rows and copies are one text in the
    statistics and a row each here; rows without id count like others.  Other columns are
    ignored; an empty table gives none.  version is a hash of the text; text is null where
    nothing was found.  The terms of a text do not depend on order; ties need no rule.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    found = stored(found_in(docs), "spans")
    total = texts.select(F.count_distinct(F.xxhash64("text"))).first()[0]

    part = found.filter("text is not null")
    listed = F.concat(*[F.coalesce(F.transform(k, lambda s, k=k: F.struct(
        F.concat_ws(":", F.lit(k), F.lower(s["value"])).alias("entity"), s["left"].alias("left"), s["right"].alias("right"))),
        F.array().cast("array<struct<entity:string,left:string,right:string>>")) for k in KINDS])
    mentions = part.select("version", F.inline(listed))
    told = stored(disclosing(mentions, texts, total, min_docs, min_disclosure, min_pmi).select("entity", "term"), "disclosing")
    inside = mentions.select("version", "entity").distinct().join(told, "entity").groupBy("version").agg(
        F.sort_array(F.collect_set("term")).alias("terms"))

    candidates = part.select("version", F.inline("secret")).withColumn("cue", _one_blank(F.col("cue")))
    candidates = stored(candidates.select("version", "value", "start", "end", "cue").distinct(), "candidates")
    # tables of known size: a cue or value of many texts is not dealt to one task while they are small
    after = stored(cues(candidates, texts, total, min_docs, min_disclosure, min_cue_bits), "after")
    values = stored(candidates.join(after, "cue", "left_semi").select("value").distinct(), "values")
    kept = candidates.join(values, "value", "left_semi").groupBy("version").agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "value"))).alias("secrets"))

    # the one letter whose lower case is two signs; what else the pattern takes for it is no term
    wanted = F.replace(F.array_join("terms", "|"), F.lit("i\u0307"), F.lit("\u0130"))
    pattern = F.concat(F.lit("(?iu)" + _BEFORE + "(?:"), wanted, F.lit(")" + _AFTER))
    more = stored(inside.join(kept, "version", "full").withColumnRenamed("version", "_version"), "told")
    out = found.join(more, F.col("version") == F.col("_version"), "left")
    term = F.when(F.col("terms").isNotNull(), F.filter(located(F.col("text"), pattern), lambda s: F.array_contains("terms", F.lower(s["value"]))))
    return out.select("doc_id", "version", "text", *KINDS, term.alias("term"), F.col("secrets").alias("secret"))


def rewritten(rows: DataFrame) -> Column:
    """The text of a row of ``personal_data`` with the kind, in brackets, in place of each span.

    Of overlapping spans the first, then the longest, is the one replaced.
    """
    empty = F.array().cast("array<struct<start:int,last:int,kind:string>>")
    spans = F.sort_array(F.concat(*[F.coalesce(F.transform(k, _mark(k)), empty) for k in (*KINDS, *ADDED)]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.array(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["kind"])
        return F.when(s["start"] >= acc["at"], F.struct((-s["last"]).alias("at"), F.concat(acc["out"], more).alias("out"))).otherwise(acc)

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))


def sanitised(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the kind, in brackets, in place of each span; see ``rewritten``."""
    rows = personal_data(docs, **settings).filter("text is not null")
    clean = stored(rows.select(F.col("version").alias("_version"), rewritten(rows).alias("_text")).dropDuplicates(["_version"]), "sanitised")
    both = docs.join(clean, F.sha2(F.col("text").cast("string"), 256) == F.col("_version"), "left")
    return both.withColumn("text", F.coalesce("_text", F.col("text"))).select(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"))
    base = F.concat(*[_listed(k) for k in KINDS])
    sizes = [F.when(F.col(k).isNull(), 0).otherwise(F.size(k)).cast("long").alias(f"n_{k}") for k in (*KINDS, *ADDED)]
    total = sum((F.col(f"n_{k}") for k in (*KINDS, *ADDED)), F.lit(0))
    clean = F.when(F.col("text").isNull(), F.col("version")).otherwise(F.sha2(rewritten(found), 256))
    out = found.select("doc_id", *sizes, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                       F.array_join(F.concat(base, *[_listed(k) for k in ADDED]), ",").alias("spans"), clean.alias("sanitised_sha256"))
    return out.withColumn("n_spans", total.cast("long"))
