"""A corpus of Python files made from table rows by arithmetic.

Twenty rows make one module.  Each column below is an expression both Spark SQL and
DuckDB read, so the expected inventory is known without parsing: the oracle computes
names, lines and docstrings from the same numbers, and never looks at the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

NL = "chr(10)"


def _body(indent: int) -> str:
    return "'" + "".join(" " * indent + f"v{i} = {i}|" for i in range(1, 9)) + "'"


# name -> expression over (id, size) and the names above it.
COLUMNS = {
    "k": "CAST(id % 20 AS INT)",
    "m": "CAST(floor(id / 20) AS BIGINT)",
    "path": """CASE WHEN m % 17 = 0 THEN 'src/p' || CAST(m AS VARCHAR(20)) || '/__init__.py'
        WHEN m % 13 = 0 THEN '.hidden/mod_' || CAST(m AS VARCHAR(20)) || '.py'
        WHEN m % 11 = 0 THEN 'tests/test_mod_' || CAST(m AS VARCHAR(20)) || '.py'
        ELSE 'src/pkg' || CAST(m % 7 AS VARCHAR(20)) || '/mod_' || CAST(m AS VARCHAR(20)) || '.py' END""",
    "broken": "m % 19 = 18",
    "method": "k >= 10",
    "stub": "k = 19",
    "ind": "CASE WHEN k >= 10 THEN '    ' ELSE '' END",
    "name": "'fn_' || CAST(k AS VARCHAR(20)) || '_' || CAST(m AS VARCHAR(20))",
    "class_name": "'C_' || CAST(m AS VARCHAR(20))",
    "class_doc": "m % 3 = 0",
    "class_head": f"""CASE WHEN k <> 10 THEN '' WHEN m % 3 = 0
        THEN 'class ' || class_name || ':' || {NL} || '    \"\"\"Class ' || class_name || '.\"\"\"' || {NL}
        ELSE 'class ' || class_name || ':' || {NL} END""",
    "class_lines": "CASE WHEN k <> 10 THEN 0 WHEN m % 3 = 0 THEN 2 ELSE 1 END",
    "deco": f"CASE WHEN NOT stub AND k % 5 = 2 THEN ind || '@cached' || {NL} ELSE '' END",
    "deco_lines": "CASE WHEN NOT stub AND k % 5 = 2 THEN 1 ELSE 0 END",
    "is_async": "NOT stub AND k % 4 = 1",
    "args_text": """CASE WHEN stub THEN 'self' ELSE
        CASE WHEN method THEN 'self, ' ELSE '' END || 'a: int'
        || CASE WHEN k % 2 = 0 THEN ', b: str = "x, y"' ELSE '' END
        || CASE WHEN k % 6 = 5 THEN ', *args' ELSE '' END
        || CASE WHEN k % 7 = 3 THEN ', **kwargs' ELSE '' END END""",
    "args_shown": "replace(args_text, ' = \"x, y\"', '')",
    "n_args": """CASE WHEN stub THEN 1 ELSE 1 + CASE WHEN method THEN 1 ELSE 0 END
        + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 6 = 5 THEN 1 ELSE 0 END
        + CASE WHEN k % 7 = 3 THEN 1 ELSE 0 END END""",
    "returns": "CASE WHEN NOT stub AND k % 3 = 1 THEN 'int' END",
    "ret_text": "CASE WHEN returns IS NOT NULL THEN ' -> int' ELSE '' END",
    "long_head": "NOT stub AND k % 9 = 4",
    "head": f"""ind || CASE WHEN is_async THEN 'async ' ELSE '' END || 'def ' || name || '('
        || CASE WHEN long_head THEN {NL} || ind || '        ' || args_text || {NL} || ind
           ELSE args_text END
        || ')' || ret_text || ':' || CASE WHEN stub THEN ' pass' ELSE '' END || {NL}""",
    "head_lines": "CASE WHEN long_head THEN 3 ELSE 1 END",
    "documented": "NOT stub AND k % 3 = 0",
    "long_doc": "NOT stub AND k % 6 = 0",
    "doc_text": f"""CASE WHEN NOT documented THEN NULL WHEN long_doc
        THEN 'Doc ' || CAST(k AS VARCHAR(20)) || '.' || {NL} || 'def fake_' || CAST(k AS VARCHAR(20)) || '(x):'
        ELSE 'Doc ' || CAST(k AS VARCHAR(20)) || '.' END""",
    "doc": f"""CASE WHEN NOT documented THEN '' ELSE ind || '    \"\"\"' || doc_text
        || CASE WHEN long_doc THEN {NL} || ind || '    ' ELSE '' END || '\"\"\"' || {NL} END""",
    "doc_lines": "CASE WHEN long_doc THEN 3 WHEN documented THEN 1 ELSE 0 END",
    "ghost": "NOT stub AND k % 8 = 7",
    "ghost_text": f"CASE WHEN ghost THEN ind || '    # def ghost():' || {NL} ELSE '' END",
    "body_lines": "CASE WHEN stub THEN 0 ELSE CAST(size % 8 + 1 AS INT) END",
    "body": f"""CASE WHEN method THEN replace(substr({_body(8)}, 1, body_lines * 15), '|', {NL})
        ELSE replace(substr({_body(4)}, 1, body_lines * 11), '|', {NL}) END""",
    "preview": f"""CASE WHEN stub THEN ''
        WHEN ghost THEN '# def ghost():' || {NL} ||
            replace(substr({_body(0)}, 1, least(body_lines, 4) * 7 - 1), '|', {NL})
        ELSE replace(substr({_body(0)}, 1, least(body_lines, 5) * 7 - 1), '|', {NL}) END""",
    "piece": "class_head || deco || head || doc || ghost_text || body",
    "before": "class_lines + deco_lines",
    "n_lines": """class_lines + deco_lines + head_lines + doc_lines
        + CASE WHEN ghost THEN 1 ELSE 0 END + body_lines + 1""",
    "n_stmts": "class_lines + deco_lines + 1 + CASE WHEN documented THEN 1 ELSE 0 END + body_lines",
}

# How a table gives (id, size).
SEEDS = {
    "part": ("p_partkey", "p_size"),
    "orders": ("o_orderkey", "o_custkey"),
}


def pieces(spark: SparkSession, sf_dir: str, table: str = "part") -> DataFrame:
    key, size = SEEDS[table]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(
        F.col(key).alias("id"), F.col(size).alias("size")
    )
    # One select; a column may name those above it.
    return df.selectExpr("*", *[f"{text} AS {name}" for name, text in COLUMNS.items()])


def corpus(spark: SparkSession, sf_dir: str, table: str = "part") -> DataFrame:
    """``path, source``: twenty pieces per module, each followed by a blank line."""
    # Scanning is bound by CPU, not bytes: an explicit count keeps all cores busy, and
    # the aggregate uses the same partitioning.
    parts = spark.sparkContext.defaultParallelism
    packed = pieces(spark, sf_dir, table).repartition(parts, "path").groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("p"),
        F.bool_or("broken").alias("broken"),
    )
    text = F.concat(
        F.array_join(F.transform("p", lambda p: p["piece"]), "\n"),
        F.when(F.col("broken"), "\ndef broken(").otherwise(""),
    )
    return packed.select("path", text.alias("source"))


def oracle(select: str, table: str = "part") -> str:
    """DuckDB query over ``fx`` (one row per function, with its ``line_number``),
    ``good`` (those in readable modules) and ``files``."""
    key, size = SEEDS[table]
    inner = f"SELECT {key} AS id, {size} AS size FROM {table}"
    for name, text in COLUMNS.items():
        inner = f"SELECT *, {text} AS {name} FROM ({inner})"
    return f"""WITH fx AS (
        SELECT *, CAST(first_line + before AS INTEGER) AS line_number,
            CASE WHEN method THEN class_name END AS parent_class
        FROM (SELECT *, 1 + coalesce(sum(n_lines) OVER (PARTITION BY m ORDER BY k
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_line
              FROM ({inner}))),
    good AS (SELECT * FROM fx WHERE NOT broken),
    files AS (SELECT path, m, bool_or(broken) AS broken,
            string_agg(piece, chr(10) ORDER BY k)
              || CASE WHEN bool_or(broken) THEN chr(10) || 'def broken(' ELSE '' END AS source,
            CAST(sum(n_lines) AS BIGINT) AS n_lines
        FROM fx GROUP BY path, m)
    {select}"""
