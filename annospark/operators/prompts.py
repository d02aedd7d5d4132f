"""Prompts for records that lack an annotation, and what sending them costs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

TEMPLATE = (
    "Below is how a Python function begins.\n"
    "\n"
    "{signature}\n"
    "{body_preview}\n"
    "{existing}\n"
    "Reply with the text of its docstring in {style} form and with nothing around it, neither quotes nor fences. "
    "Open with one sentence on what the function is for. "
    "Then take its arguments by name and say what comes back. "
    "Leave out errors that these lines do not show."
)
EXISTING = "\nWhat its docstring says so far:\n"

# Documented tokens per function, input and output.
TOKENS_IN, TOKENS_OUT = 400, 200
CHARS_PER_TOKEN = 4


def signature(name: Column, params: Column, return_type: Column) -> Column:
    """``def name(a: int, *args) -> str:``"""
    listed = F.array_join(
        F.transform(
            params,
            lambda p: F.when(
                F.coalesce(p["type_hint"], F.lit("")) != "",
                F.concat(p["name"], F.lit(": "), p["type_hint"]),
            ).otherwise(p["name"]),
        ),
        ", ",
    )
    arrow = F.when(
        F.coalesce(return_type, F.lit("")) != "", F.concat(F.lit(" -> "), return_type)
    ).otherwise("")
    return F.concat(F.lit("def "), name, F.lit("("), listed, F.lit(")"), arrow, F.lit(":"))


def existing_section(existing: Column) -> Column:
    """Section with the present annotation; empty when there is none or it is empty."""
    return F.when(
        F.length(F.coalesce(existing, F.lit(""))) > 0, F.concat(F.lit(EXISTING), existing)
    ).otherwise("")


def fill(template: str, slots: Mapping[str, Column]) -> Column:
    """Template text with ``{slot}`` replaced by columns, in one concat."""
    pieces: list[Column] = []
    rest = template
    while rest:
        at = {name: rest.find("{" + name + "}") for name in slots}
        found = [(pos, name) for name, pos in at.items() if pos >= 0]
        if not found:
            pieces.append(F.lit(rest))
            break
        pos, name = min(found)
        if pos:
            pieces.append(F.lit(rest[:pos]))
        pieces.append(slots[name])
        rest = rest[pos + len(name) + 2 :]
    return F.concat(*pieces)


def prompts(
    functions: DataFrame,
    style: str | Column = "google",
    template: str = TEMPLATE,
    settings: DataFrame | None = None,
    project: str = "project",
) -> DataFrame:
    """Adds ``prompt`` and its hash ``prompt_key``.

    With ``settings`` (one row per project, a ``style`` column) the style of each
    record's project is used, ``style`` where the project has none.
    """
    chosen = F.lit(style) if isinstance(style, str) else style
    rows = functions
    if settings is not None:
        styles = settings.select(project, F.col("style").alias("_style"))
        rows = functions.join(styles, project, "left")
        chosen = F.coalesce("_style", chosen)
    text = fill(
        template,
        {
            "style": F.initcap(chosen),
            "signature": signature(F.col("name"), F.col("params"), F.col("return_type")),
            "body_preview": F.col("body_preview"),
            "existing": existing_section(F.col("existing_docstring")),
        },
    )
    return rows.withColumn("prompt", text).withColumn(
        "prompt_key", F.sha2("prompt", 256)
    ).drop("_style")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN)


def cost(
    rows: DataFrame,
    prices: Mapping[str, tuple[float, float]],
    by: Sequence[str] = (),
    tokens_in: Column | None = None,
    tokens_out: Column | None = None,
) -> DataFrame:
    """Tokens and cost per model (and group): ``prices`` maps a model to its price per
    million input and output tokens.

    Tokens are summed first; the few price rows are then set beside the sums, not
    beside the records.  Without token columns the documented averages are used.
    """
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("records"),
        F.sum(F.lit(TOKENS_IN) if tokens_in is None else tokens_in).cast("long").alias("tokens_in"),
        F.sum(F.lit(TOKENS_OUT) if tokens_out is None else tokens_out).cast("long").alias("tokens_out"),
    )
    table = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(i).alias("usd_in"), F.lit(o).alias("usd_out"))
            for m, (i, o) in prices.items()
        ]
    )
    usd = (F.col("tokens_in") * F.col("p.usd_in") + F.col("tokens_out") * F.col("p.usd_out")) / 1e6
    return sums.withColumn("p", F.explode(table)).select(
        *by, F.col("p.model").alias("model"), "records", "tokens_in", "tokens_out",
        usd.alias("usd"),
    )
