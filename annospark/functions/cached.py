"""Columns built once per Spark context.

A column that names its inputs belongs to no DataFrame and can be used in any plan.
Building a large one takes thousands of small calls into the JVM, so the scanner
builds each of its columns once and uses it in every query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark import SparkContext

T = TypeVar("T")


def per_context(build: Callable[..., T]) -> Callable[..., T]:
    held: dict = {}

    @wraps(build)
    def get(*args) -> T:
        context = SparkContext._active_spark_context
        if held.get("context") is not context:
            held.clear()
            held["context"] = context
        if args not in held:
            held[args] = build(*args)
        return held[args]

    return get
