"""Corpus tables ``(path, source)`` in and out of storage."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from annospark import schemas
from annospark.operators import rules
from annospark.sources.shared import shared_folder

_ENTRY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("is_dir", T.BooleanType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("parent", T.StringType()),
    ]
)
_CONTENT = T.StructType(
    [T.StructField("path", T.StringType(), False), T.StructField("content", T.BinaryType())]
)

READ_TASK_BYTES = 128 << 20
READ_BATCH_BYTES = 16 << 20


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus stored as parquet."""
    return spark.read.schema(schemas.SOURCE_FILES).parquet(path)


def write_corpus(corpus: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a new version of a corpus.  Never write over the version being read."""
    corpus.select("path", "source").write.mode(mode).parquet(path)


def new_version(corpus: DataFrame, changed: DataFrame) -> DataFrame:
    """``corpus`` with the rows of ``changed`` in place of those with the same path."""
    kept = corpus.join(changed.select("path"), "path", "left_anti")
    return kept.select("path", "source").unionByName(changed.select("path", "source"))


def suffix(path: Column) -> Column:
    """Last extension of the file name with its dot, or an empty string.

    A name such as ``.py`` is all stem and has no extension.
    """
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def by_extension(df: DataFrame, extensions: Sequence[str], path: str = "path") -> DataFrame:
    """Rows whose path has one of the extensions."""
    return df.where(suffix(F.col(path)).isin(*extensions))


def _prefix(root: str) -> str:
    """What a path below ``root`` has in front of the name its file system knows."""
    from pyarrow import fs

    _, inner = fs.FileSystem.from_uri(root)
    return root[: len(root) - len(inner)] if root.endswith(inner) else ""


def _lister(root: str, prefix: str):
    def list_dirs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch["path"]:
                inside = fs.FileSelector(folder[len(prefix) :], allow_not_found=True)
                found = store.get_file_info(inside)
                yield pd.DataFrame(
                    {
                        "path": [prefix + f.path for f in found],
                        "is_dir": [f.type == fs.FileType.Directory for f in found],
                        "size": [f.size or 0 for f in found],
                        "parent": folder,
                    }
                )

    return list_dirs


def _reader(root: str, prefix: str):
    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small files together, a larger one by itself: it is held once, in the buffer that is sent."""
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)

        def made(paths: list[str], contents: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), contents], ["path", "content"])

        def whole(path: str, size: int) -> pa.Array:
            with store.open_input_file(path[len(prefix) :]) as file:
                data = file.read_buffer(size)
            return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(struct.pack("<ii", 0, data.size)), data])

        paths, contents, held = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                size = store.get_file_info(path[len(prefix) :]).size or 0
                if READ_BATCH_BYTES <= size < 1 << 31:
                    yield made([path], whole(path, size))
                    continue
                with store.open_input_stream(path[len(prefix) :], compression=None) as stream:
                    data = stream.read()
                paths.append(path)
                contents.append(data)
                held += len(data)
                if held >= READ_BATCH_BYTES:
                    yield made(paths, pa.array(contents, pa.binary()))
                    paths, contents, held = [], [], 0
        if paths:
            yield made(paths, pa.array(contents, pa.binary()))

    return read_files


def ignore_patterns(root: str, name: str) -> list[str]:
    """Lines of the ignore file ``name`` of a folder; none where there is no such file."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(root.rstrip("/") or "/")
    place = f"{inner.rstrip('/')}/{name}"
    if store.get_file_info(place).type != fs.FileType.File:
        return []
    with store.open_input_stream(place, compression=None) as stream:
        return stream.read().decode("utf-8", "replace").splitlines()


def walked(
    spark: SparkSession, root: str, exclude: Sequence[str] = (), ignore: Sequence[str] = ()
) -> DataFrame:
    """``path, is_dir, size, parent`` of all that is found below the folder ``root``.

    Spark's own file sources skip names that start with ``_`` or ``.``, so packages'
    ``__init__.py`` files would be lost.  Folders are listed level by level as a
    Spark job each; a level is kept as a table in the shared folder, so a lost
    executor repeats at most one level.  Folders that start with a dot, and those that a rule list
    excludes, stand in the result but are not entered: nothing below them is listed.
    """
    table, prefix = shared_folder(spark, "listing"), _prefix(root)
    frontier = spark.createDataFrame([(root, True, 0, None)], _ENTRY)
    inside = F.substring("path", len(root.rstrip("/")) + 2, 2**31 - 1)
    level = 0
    while True:
        here = f"{table}/level={level}"
        frontier.select("path").mapInPandas(_lister(root, prefix), _ENTRY).write.parquet(here)
        closed = F.regexp_extract("path", r"[^/]*$", 0).startswith(".")
        for patterns in (exclude, ignore):
            closed = closed | rules.excluded_folder(inside, patterns)
        folders = spark.read.schema(_ENTRY).parquet(here).where(F.col("is_dir") & ~closed)
        if folders.isEmpty():
            break
        frontier = folders.repartition(spark.sparkContext.defaultParallelism, "path")
        level += 1
    return spark.read.schema(_ENTRY).parquet(*[f"{table}/level={n}" for n in range(level + 1)])


def list_tree(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str],
    exclude: Sequence[str] = (),
    ignore_file: str | None = None,
) -> DataFrame:
    """``path, size`` of the files below ``root`` with one of the extensions.

    ``exclude`` and the lines of the root's own ``ignore_file`` are rule lists relative to
    the root; what either excludes is left out, and folders they exclude are never listed.  A
    ``root`` that is a file is taken whatever the rules, one that is absent gives no rows.
    """
    from pyarrow import fs

    empty = spark.createDataFrame([], _ENTRY)
    root = root.rstrip("/") or "/"
    store, inner = fs.FileSystem.from_uri(root)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        return empty.select("path", "size")
    if info.type == fs.FileType.File:
        one = spark.createDataFrame([(root, False, info.size or 0, None)], _ENTRY)
        return by_extension(one, extensions).select("path", "size")
    ignore = ignore_patterns(root, ignore_file) if ignore_file else []
    files = by_extension(walked(spark, root, exclude, ignore).where(~F.col("is_dir")), extensions)
    inside = F.substring("path", len(root.rstrip("/")) + 2, 2**31 - 1)
    gone = rules.excluded(inside, exclude) | rules.excluded(inside, ignore)
    return files.where(~gone).select("path", "size")


def ingest_binary(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str],
    exclude: Sequence[str] = (),
    ignore_file: str | None = None,
) -> DataFrame:
    """``path, content`` of the files below ``root`` (a folder or one file)."""
    root = root.rstrip("/") or "/"
    listed = list_tree(spark, root, extensions, exclude, ignore_file)
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(total / READ_TASK_BYTES))
    # An explicit count: the listing is tiny, so AQE would merge it into one reader.
    read = _reader(root, _prefix(root))
    return listed.repartition(parts, "path").select("path").mapInArrow(read, _CONTENT)


def ingest_tree(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] = (".py",),
    exclude: Sequence[str] = (),
    ignore_file: str | None = None,
) -> DataFrame:
    """Corpus table of a folder tree or a single file.

    Rules apply while folders are listed, as in ``list_tree``.  A file that is not UTF-8 keeps its
    row with a null ``source``; scanning reports it as an error.
    """
    text = F.expr("try_validate_utf8(cast(content as string))")
    found = ingest_binary(spark, root, extensions, exclude, ignore_file)
    return found.select("path", text.alias("source"))
