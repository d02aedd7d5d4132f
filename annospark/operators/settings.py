"""Layered settings per project, kept as ``(project, key, layer, value)`` rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Layers from weak to strong, defaults, and what a setting may be.
LAYERS = ("default", "file", "env", "arg")
DEFAULTS = {
    "style": "google",
    "provider": "anthropic",
    "model": "claude-3-5-sonnet-20241022",
    "overwrite_existing": "false",
    "max_retries": "3",
    "timeout": "30",
}
KEYS = (*DEFAULTS, "base_url", "exclude")
ALLOWED = {
    "style": ("google", "numpy", "sphinx"),
    "provider": ("anthropic", "openai", "ollama"),
}
RANGES = {"max_retries": (1, 10), "timeout": (5, 300)}


def default_rows(projects: DataFrame, defaults: Mapping[str, str] = DEFAULTS) -> DataFrame:
    """The weakest layer, for every project."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in defaults.items()]
    )
    return projects.select("project", F.explode(pairs).alias("d")).select(
        "project", "d.key", F.lit("default").alias("layer"), "d.value"
    )


def resolve(
    settings: DataFrame, keys: Sequence[str] = KEYS, layers: Sequence[str] = LAYERS
) -> DataFrame:
    """One row per project: each key from its strongest layer that has a value.

    One aggregate with a column per key; nulls never override.
    """
    rank = F.array_position(F.array(*[F.lit(name) for name in layers]), F.col("layer"))
    given = settings.where(F.col("value").isNotNull() & (rank > 0))

    def pick(key: str) -> Column:
        mine = F.col("key") == key
        return F.max_by(F.when(mine, F.col("value")), F.when(mine, rank)).alias(key)

    return given.groupBy("project").agg(*[pick(k) for k in keys])


def with_overrides(resolved: DataFrame, **overrides: str | None) -> DataFrame:
    """Arguments of this call set over resolved settings; ``None`` keeps the value."""
    for key, value in overrides.items():
        if value is not None and key in resolved.columns:
            resolved = resolved.withColumn(key, F.lit(value))
    return resolved


def violations(
    resolved: DataFrame,
    allowed: Mapping[str, Sequence[str]] = ALLOWED,
    ranges: Mapping[str, tuple[int, int]] = RANGES,
) -> DataFrame:
    """Adds ``violations``: every broken rule of the row, as text."""
    checks = [
        F.when(
            ~F.col(k).isin(*values),
            F.concat(F.lit(f"{k}: "), F.col(k), F.lit(f" is not one of {', '.join(values)}")),
        )
        for k, values in allowed.items()
    ]
    for k, (low, high) in ranges.items():
        number = F.col(k).try_cast("int")
        ok = number.between(low, high)
        checks.append(
            F.when(
                F.col(k).isNotNull() & ~F.coalesce(ok, F.lit(False)),
                F.concat(F.lit(f"{k}: "), F.col(k).cast("string"), F.lit(f" is not in {low}..{high}")),
            )
        )
    return resolved.withColumn("violations", F.array_compact(F.array(*checks)))


_SECTIONS = """
    style string, provider string, model string, base_url string,
    overwrite_existing string, max_retries string, timeout string,
    exclude string, llm struct<provider:string, model:string, base_url:string,
    max_retries:string, timeout:string>
"""


def flatten_settings(rows: DataFrame, json: str = "json", layer: str = "file") -> DataFrame:
    """Settings rows from one JSON text per project.

    ``llm`` entries move to the top and win over it; ``exclude`` may be a list or an
    object with ``patterns`` and stays a JSON list.
    """
    text = F.col(json)
    parsed = rows.withColumn("_j", F.from_json(text, _SECTIONS))
    listed = F.when(
        F.col("_j.exclude").startswith("{"), F.get_json_object("_j.exclude", "$.patterns")
    ).otherwise(F.col("_j.exclude"))
    nested = {"provider", "model", "base_url", "max_retries", "timeout"}
    pairs = []
    for key in KEYS:
        top = F.col(f"_j.{key}")
        value = F.coalesce(F.col(f"_j.llm.{key}"), top) if key in nested else top
        pairs.append(
            F.struct(
                F.lit(key).alias("key"), (listed if key == "exclude" else value).alias("value")
            )
        )
    return (
        parsed.select("project", F.explode(F.array(*pairs)).alias("s"))
        .where(F.col("s.value").isNotNull())
        .select("project", "s.key", F.lit(layer).alias("layer"), "s.value")
    )


def exclude_patterns(value: Column) -> Column:
    """The ``exclude`` setting as an array."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))
