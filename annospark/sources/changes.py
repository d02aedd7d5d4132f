"""Records named by a change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Added, copied, modified.
CHANGED = ("A", "C", "M")


def latest_changes(changes: DataFrame, key: str = "path", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Last status per key.  The aggregate combines map-side, so a hot key is cheap."""
    return changes.groupBy(key).agg(F.max_by("status", F.struct(*order)).alias("status"))


def changed_only(
    corpus: DataFrame,
    changes: DataFrame,
    statuses: Sequence[str] = CHANGED,
    key: str = "path",
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Corpus rows whose latest change has one of the statuses."""
    wanted = latest_changes(changes, key, order).where(F.col("status").isin(*statuses))
    return corpus.join(wanted.select(key), key, "left_semi")
