"""Give a computed value a name inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used inside a lambda is computed again per element, and one used several
    times may be computed several times.  As the element of a one-element array it is
    a lambda variable, which is only read.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows with ``columns`` behind a one-row explode.

    Catalyst copies a computed column into every filter it pushes below it, also into
    the filter it infers for an inner explode; copied into a lambda, an array would be
    rebuilt per element.  It pushes no filter on generated columns.
    """
    rest = [c for c in df.columns if c not in columns]
    packed = F.explode_outer(F.array(F.struct(*columns)))
    return df.select(*rest, packed.alias("_settled")).select(*rest, "_settled.*")
