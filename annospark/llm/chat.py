"""Chat formatting over a prefix tree of conversations.

Conversations that share their first turns share the nodes of those turns.  A node's key
is the SHA-256 of its parent's key, role and text.  Each node's formatted text is given
out once, in depth-first order, with

* ``start``: where it begins in the packed sequence of all nodes,
* ``position``: where it begins in its own conversations (position ids count from there),
* ``attends``: the packed intervals of its ancestors, which it may attend to besides itself,
* ``loss_start``, ``loss_end``: what of it is trained on, none for other roles than assistant.

A turn is written ``<s>[role] text </s>``.  In roles and texts ``\\``, ``<``, ``[`` and
``]`` get a ``\\`` before them, so no text can pass for a control string and reading back
gives the text again.

A first turn that a third of all conversations share is one row from the start: nodes are
counted with partial sums, and joins that bring it back to the conversations have one row
on that side, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annospark.llm.common import ranked, read, stored

OPEN, INNER, CLOSE = "<s>[", "] ", " </s>"
#: The role that is trained on.
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[\]])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\<\[\]])", "$1")


def formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(INNER), escaped(text), F.lit(CLOSE))


#: Role and text of a written turn: the first bare bracket ends the role.
WRITTEN = r"(?s)^<s>\[((?:[^\\\]]|\\.)*+)\] (.*) </s>$"


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys): the nodes of each conversation from its first turn on, and its turns.

    Rows are taken by turn; equal turns, and null ones, which come first, by role and text.
    Null roles and texts are empty ones.  Rows without conv_id belong to no conversation.
    """
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))
    # lengths part the fields, so no two turns read alike
    chain = F.expr("""aggregate(turns, cast(array() as array<string>), (keys, t) -> concat(keys, array(
        sha2(concat_ws(' ', element_at(concat(array(''), keys), -1), length(t.role), t.role, t.text), 256))))""")
    return whole.select("conv_id", "turns", chain.alias("keys"))


def tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The packed nodes, and (conv_id, depth, node) that says which of them a conversation has.

    Nodes: node, parent, depth (from 0), content, start, position, attends (array of start
    and end, ends exclusive), loss_start, loss_end, all counted in code points.
    """
    own = stored(paths(conversations), "conversations")
    members = own.select("conv_id", F.posexplode("keys").alias("depth", "node"))
    # the order of the leaves is the order of their paths; a node comes with its first leaf
    leaves = own.groupBy(F.element_at("keys", -1).alias("leaf")).agg(F.min_by(F.struct("turns", "keys"), "conv_id").alias("p"))
    # a path's nodes fix its place; the key of the leaf parts paths that begin alike
    order = F.transform("p.keys", lambda k: F.substring(k, 1, 16))
    leaves = ranked(leaves.withColumn("path", F.array_join(order, "")), ["path", "leaf"], "leaves")
    steps = leaves.select("rank", F.posexplode(F.arrays_zip("p.turns", "p.keys")).alias("depth", "z"), F.col("p.keys").alias("keys"))
    nodes = steps.select(
        F.col("z.keys").alias("node"), "depth", F.when(F.col("depth") > 0, F.get("keys", F.col("depth") - 1)).alias("parent"),
        F.col("z.turns.role").alias("role"), formatted(F.col("z.turns.role"), F.col("z.turns.text")).alias("content"), "rank")
    first = nodes.groupBy("node").agg(F.min_by(F.struct("depth", "parent", "role", "content", "rank"), "rank").alias("n"))
    first = first.select("node", "n.*").withColumnRenamed("rank", "leaf_rank").withColumn("size", F.length("content"))
    packed = stored(ranked(first, ["leaf_rank", "depth"], "nodes", weight="size").drop("rank", "leaf_rank"), "packed")
    spans = packed.select(F.col("node").alias("ancestor"), F.col("before").alias("start"), "size")
    # a node's ancestors, from the path it was first met on
    lines = leaves.select(F.posexplode("p.keys").alias("depth", "node"), F.col("p.keys").alias("keys"), "rank").groupBy("node").agg(
        F.min_by(F.slice("keys", 1, F.col("depth")), "rank").alias("above"))
    up = lines.select("node", F.explode("above").alias("ancestor")).join(spans, "ancestor").groupBy("node").agg(
        F.sum("size").alias("position"),
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("attends"))
    head = F.length(F.lit(OPEN)) + F.length(escaped(F.col("role"))) + F.length(F.lit(INNER))
    trained = F.col("role") == TRAINED
    out = packed.join(up, "node", "left").select(
        "node", "parent", "depth", "content", F.col("before").alias("start"), F.coalesce("position", F.lit(0)).alias("position"),
        F.coalesce("attends", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("attends"),
        F.when(trained, head).alias("loss_start"), F.when(trained, F.col("size") - len(CLOSE)).alias("loss_end"))
    return out, members


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text, loss, size) of each turn, from the written nodes alone."""
    parts = nodes.select(
        "node", F.regexp_extract("content", WRITTEN, 1).alias("role"), F.regexp_extract("content", WRITTEN, 2).alias("text"),
        F.expr("substring(content, loss_start + 1, loss_end - loss_start)").alias("loss"), F.length("content").alias("size"))
    return members.join(parts, "node").select(
        "conv_id", "depth", unescaped(F.col("role")).alias("role"), unescaped(F.col("text")).alias("text"),
        unescaped(F.col("loss")).alias("loss"), "size")


def digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``read_back``."""
    row = F.struct("depth", "role", "text", F.coalesce("loss", F.lit("")).alias("loss"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"), F.sum("size").alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("t.loss", "")
    return whole.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
                                "conv_id long, turn long, role string, text string")
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nodes, members = tree(given.unionByName(own))
    return digests(read_back(nodes, members))


OP9_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
           sum(11 + length(regexp_replace(role || text, '([\\<\[\]])', '\\\1', 'g'))) AS formatted_chars
    FROM rows GROUP BY conv_id
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM whole
"""
