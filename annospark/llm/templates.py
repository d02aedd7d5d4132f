"""Line dedup by a tree of log templates.

Every line is parsed to a fixed depth: its number of tokens, then its first ``LEAD`` tokens,
where a token with a digit is the variable field ``<*>``.  That is its leaf.  In a leaf stand

* the lines' exact templates, that is the lines with their variable fields replaced, and
* general templates.  The exact templates of a leaf are gone through by falling number of
  documents (ties: smallest first document, then text).  Each joins the first general template
  whose seed it resembles: at least ``SIMILAR`` of the tokens after the leading ones stand in
  place, one of them constant text.  One that resembles none seeds the next.  The tokens in
  which members differ are variable.  So a leaf has as many families as its lines make.

A line of fewer than ``MIN_TOKENS`` tokens, or one that is mostly fields (a row of numbers),
stands for itself, digits included, and joins no general template.

A template that ``MIN_DOCS`` documents hold is recurring, one of ``LONG`` bytes or more from two
documents on.  Its lines are dropped from all documents but the one of smallest id, so that one
copy of every passage stays.

DataFrame functions only.  Lines travel as hashes.  Only lines of leaves with several templates
are compared, and of those only the ones that share a block of tokens with another.  A template
of a third of all lines is counted in partial sums per document first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from annospark.llm.common import marks, read, stored, struck

LEAD = 3
MIN_TOKENS = 3
MIN_DOCS = 3
LONG = 60
SIMILAR = 0.6
FIELD = "<*>"
#: Templates of a leaf among which seeds are found at once: in the first round, and at most.
SEEDS, MOST_SEEDS = 32, 512


def parsed(docs: DataFrame) -> DataFrame:
    """(doc_id, version, pos, form, n, free) of each line that is not blank.

    version parts different texts of one id; form is the exact template, n its number of tokens;
    free says whether it may join a general template.
    """
    lines = docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.expr("trim(BOTH ' \t\r' FROM line) <> ''"))
    blank = F.trim(F.translate("line", "\t\r", "  "))
    flat = lines.select("doc_id", "version", "pos", blank.alias("flat")).withColumn(
        "flat", F.when(F.contains("flat", F.lit("  ")), F.regexp_replace("flat", " +", " ")).otherwise(F.col("flat")))
    # an unbroken run without digits is passed in one step, so long runs take linear time
    masked = F.when(F.col("flat").rlike("[0-9]"), F.regexp_replace("flat", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(F.col("flat"))

    def times(text: str, part: str) -> Column:
        return (F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit(part), F.lit("")))) / len(part)

    cut = flat.withColumn("masked", masked).withColumn("n", (times("flat", " ") + 1).cast("int"))
    cut = cut.withColumn("free", (F.col("n") >= MIN_TOKENS) & (2 * times("masked", FIELD) <= F.col("n")))
    return cut.select("doc_id", "version", "pos", F.when(F.col("free"), F.col("masked")).otherwise(F.col("flat")).alias("form"), "n",
                      (F.col("free") & (F.col("n") > LEAD)).alias("free"))


def keyed(lines: DataFrame) -> DataFrame:
    """``lines`` with the hashes of their leaf and template, and the number of documents that make it recurring."""
    leaf = F.xxhash64("n", F.substring_index("form", " ", LEAD))
    need = F.when(F.octet_length("form") >= LONG, 2).otherwise(MIN_DOCS).cast("byte")
    return lines.select("doc_id", "version", "pos", leaf.alias("leaf"), F.xxhash64("form").alias("template"), need.alias("need"), "free",
                        F.when(F.col("free"), F.col("form")).alias("form"))


def alike(a: Column, b: Column, similar: float) -> Column:
    """Do two tails of equal length resemble each other?  A field is 0."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, x))
    held = F.filter(same, lambda x: x.isNotNull())
    return (F.size(held) >= F.ceil(similar * F.size(a))) & F.exists(held, lambda x: x != 0)


def partnered(pool: DataFrame, similar: float) -> DataFrame:
    """The templates of ``pool`` that can resemble another one of their leaf.

    Cut into one block more than the tokens in which two may differ, they share a block.
    """
    size = F.size("tail")
    blocks = size - F.ceil(similar * size) + 1

    def edge(i: Column) -> Column:
        return F.floor(i * size / blocks).cast("int")

    keys = F.transform(F.sequence(F.lit(0), (blocks - 1).cast("int")), lambda i: F.xxhash64("leaf", i, F.slice("tail", edge(i) + 1, edge(i + 1) - edge(i))))
    each = pool.select("leaf", "template", F.explode(keys).alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    some = each.join(shared, "key", "left_semi").select("leaf", "template").distinct()
    return pool.join(some, ["leaf", "template"], "left_semi")


def families(pool: DataFrame, similar: float) -> DataFrame:
    """(leaf, template, family): the general template, by its seed, that each template of ``pool`` joins.

    pool: (leaf, template, docs, first_doc, form, tail).  Each round finds the seeds among the foremost
    templates of every leaf and holds the rest of the leaf against them, so the outcome is that of
    going through the leaf one by one.
    """
    rest, out, seeds = stored(partnered(pool, similar), "pool"), [], SEEDS
    while True:
        place = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("docs"), "first_doc", "form"))
        front = rest.withColumn("place", place).filter(F.col("place") <= seeds).groupBy("leaf").agg(
            F.sort_array(F.collect_list(F.struct("place", "template", "tail"))).alias("front"))
        none = F.expr("cast(array() as array<struct<place:int,template:bigint,tail:array<int>>>)")

        def grow(found: Column, x: Column) -> Column:
            near = F.exists(found, lambda s: alike(s["tail"], x["tail"], similar))
            return F.when(near, found).otherwise(F.concat(found, F.array(x)))

        leaders = stored(front.select("leaf", F.aggregate("front", none, grow).alias("leaders")), "seeds")
        # every member of a leaf is cut into as many tokens: tails are of equal length
        joins = F.get(F.filter("leaders", lambda s: (s["template"] == F.col("template")) | alike(s["tail"], F.col("tail"), similar)), F.lit(0))
        after = stored(rest.join(leaders, "leaf").withColumn("family", joins["template"]).drop("leaders"), "families")
        out.append(after.filter("family is not null").select("leaf", "template", "family"))
        rest = after.filter("family is null").drop("family")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, out)
        seeds = min(2 * seeds, MOST_SEEDS)


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> DataFrame:
    """(leaf, template, exact_first, general_first): the documents that keep a template's lines."""
    held = lines.groupBy("leaf", "template", "doc_id").agg(F.first("need").alias("need"), F.first("free").alias("free"))
    held = stored(held, "held")
    exact = stored(held.groupBy("leaf", "template").agg(
        F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.first("need").alias("need"), F.first("free").alias("free")), "exact")
    leaves = exact.filter("free").groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count("*").alias("templates"))
    crowded = stored(leaves.filter((F.col("templates") > 1) & (F.col("docs") >= min_docs)).select("leaf"), "crowded")
    texts = struck(lines.filter("free").select("leaf", "template", "form"), "leaf", marks(crowded, "leaf")).filter("_struck")
    texts = texts.groupBy("leaf", "template").agg(F.first("form").alias("form"))
    tail = F.transform(F.expr(f"slice(split(form, ' '), {LEAD + 1}, size(split(form, ' ')))"), lambda x: F.when(x == FIELD, 0).otherwise(F.hash(x)))
    pool = exact.filter("free").join(crowded, "leaf", "left_semi").select("leaf", "template", "docs", "first_doc").join(
        texts, ["leaf", "template"]).withColumn("tail", tail)
    members = families(pool, similar)
    grouped = held.join(members, ["leaf", "template"]).groupBy("leaf", "family", "doc_id").agg(F.lit(1).alias("one")).groupBy("leaf", "family").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("general_first")).filter(F.col("n") >= min_docs).select("leaf", "family", "general_first")
    general = members.join(grouped, ["leaf", "family"]).select("leaf", "template", "general_first")
    alone = exact.filter(F.col("docs") >= F.least("need", F.lit(min_docs))).select("leaf", "template", F.col("first_doc").alias("exact_first"))
    return alone.join(general, ["leaf", "template"], "full")


def dropped(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, version, flags, n_dropped): flags has a 1 for each line that goes, up to the last."""
    lines = stored(keyed(parsed(docs)), "lines")
    again = stored(recurring(lines, **settings), "recurring")
    gone = lines.select("doc_id", "version", "pos", "leaf", "template").join(again, ["leaf", "template"]).filter(
        "doc_id <> coalesce(exact_first, doc_id) or doc_id <> coalesce(general_first, doc_id)")
    per = gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    steps = F.transform("p", lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.when(i > 0, F.get("p", i - 1)).otherwise(-1) - 1), F.lit("1")))
    return per.select("doc_id", "version", F.array_join(steps, "").cast("binary").alias("flags"), F.size("p").alias("n_dropped"))


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without recurring lines, with ``n_dropped``; n_chars, if a column, follows the text.

    Null and empty texts, and documents without id, stay as they are.  A text may become
    empty; its row stays.  Repeated rows of one id are one document, and each stays.
    Other columns are kept; a column n_dropped is replaced.  An empty table gives none.
    """
    names = [c for c in docs.columns if c != "n_dropped"]
    gone = stored(dropped(docs.select("doc_id", "text"), **settings), "dropped").select(
        F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "flags", F.col("n_dropped").alias("_n"))
    both = docs.select(*names).join(gone, (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_version")), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: F.coalesce(F.substring("flags", i + 1, 1), F.lit(b"")) != F.lit(b"1"))
    text = F.when(F.col("flags").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = both.withColumn("text", text)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("flags").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*names, F.coalesce("_n", F.lit(0)).alias("n_dropped"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped")
