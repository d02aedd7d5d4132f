"""Versions of a corpus that share what did not change.

A version is a manifest: for each path bucket, the folder that holds its rows.  A commit
rewrites the buckets that have changed paths and no others, then moves the new manifest
into place, so a reader sees the old version or the new one, and a write that fails
leaves the old one as it was.  Older versions stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from annospark import schemas

_ROWS = T.StructType([*schemas.SOURCE_FILES.fields, T.StructField("bucket", T.IntegerType())])


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root.rstrip("/"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")


def versions(root: str) -> list[int]:
    """Numbers of the versions below ``root``, oldest first."""
    from pyarrow import fs

    store, inner = _store(root)
    found = store.get_file_info(fs.FileSelector(f"{inner}/versions", allow_not_found=True))
    return sorted(int(f.base_name) for f in found if f.base_name.isdigit())


def manifest(root: str, version: int | None = None) -> dict:
    """``{"buckets": n, "folders": {bucket: folder}}`` of a version, the latest by default.

    Its size is bounded by the number of buckets; a bucket without rows is not in it.
    """
    known = versions(root)
    if not known or (version is not None and version not in known):
        raise ValueError(f"No version {'' if version is None else version} below {root}")
    store, inner = _store(root)
    with store.open_input_stream(f"{inner}/versions/{known[-1] if version is None else version}") as stream:
        read = json.loads(stream.read())
    return {"buckets": read["buckets"], "folders": {int(b): f for b, f in read["folders"].items()}}


def _publish(root: str, number: int, buckets: int, folders: dict[int, str]) -> int:
    """Move the manifest of version ``number`` into place; one writer at a time."""
    from pyarrow import fs

    store, inner = _store(root)
    store.create_dir(f"{inner}/versions")
    place = f"{inner}/versions/{number}"
    part = f"{place}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(json.dumps({"buckets": buckets, "folders": folders}, sort_keys=True).encode())
    if store.get_file_info(place).type != fs.FileType.NotFound:
        store.delete_file(part)
        raise RuntimeError(f"Version {number} was written by someone else")
    store.move(part, place)
    return number


def _write(rows: DataFrame, root: str) -> dict[int, str]:
    """Write (path, source, bucket) rows to a new folder; the folder of each bucket that has rows."""
    from pyarrow import fs

    folder = f"data/{uuid.uuid4().hex}"
    # dealt by bucket and path: a task holds few buckets, a large bucket is several tasks' work
    rows.repartition("bucket", F.pmod(F.hash("path"), F.lit(8))).write.partitionBy("bucket").parquet(f"{root.rstrip('/')}/{folder}")
    store, inner = _store(root)
    made = store.get_file_info(fs.FileSelector(f"{inner}/{folder}"))
    return {int(f.base_name[7:]): folder for f in made if f.base_name.startswith("bucket=")}


def create(corpus: DataFrame, root: str, buckets: int = 256) -> int:
    """Write ``corpus`` as version 0 in so many path buckets, which stay the same from then on."""
    if versions(root):
        raise ValueError(f"There are versions below {root}")
    return _publish(root, 0, buckets, _write(corpus.select("path", "source", _bucket(buckets)), root))


def _read(spark: SparkSession, root: str, folders: dict[int, str]) -> DataFrame:
    out = spark.createDataFrame([], _ROWS)
    by_folder: dict[str, list[int]] = {}
    for bucket, folder in sorted(folders.items()):
        by_folder.setdefault(folder, []).append(bucket)
    for folder, inside in by_folder.items():
        base = f"{root.rstrip('/')}/{folder}"
        paths = [f"{base}/bucket={b}" for b in inside]
        out = out.unionByName(spark.read.schema(_ROWS).option("basePath", base).parquet(*paths))
    return out


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """``path, source`` of a version, the latest by default."""
    return _read(spark, root, manifest(root, version)["folders"]).select("path", "source")


def read_paths(wanted: DataFrame, root: str, version: int | None = None) -> DataFrame:
    """``path, source`` of the paths in ``wanted``; reads no bucket that has none of them."""
    known = manifest(root, version)
    touched = _touched(wanted, known["buckets"])
    held = {b: f for b, f in known["folders"].items() if b in touched}
    return _read(wanted.sparkSession, root, held).select("path", "source").join(wanted.select("path"), "path", "left_semi")


def _touched(paths: DataFrame, buckets: int) -> set[int]:
    """Buckets of the paths: never more rows than there are buckets."""
    return {r.bucket for r in paths.where("path is not null").select(_bucket(buckets)).distinct().collect()}


def commit(changed: DataFrame, root: str, removed: DataFrame | None = None) -> int:
    """A new version with the rows of ``changed`` (path, source) in place of those of the same path.

    New paths are added, the paths in ``removed`` go; a path in both is changed.  Paths of ``changed`` are
    distinct.  Rows without a path are left out.  Without any change no version is made.
    """
    spark = changed.sparkSession
    known, last = manifest(root), versions(root)[-1]
    buckets = known["buckets"]
    changed = changed.where("path is not null").select("path", "source", _bucket(buckets))
    gone = changed.select("path", "bucket")
    if removed is not None:
        gone = gone.unionByName(removed.where("path is not null").select("path", _bucket(buckets)))
    touched = _touched(gone, buckets)
    if not touched:
        return last
    old = _read(spark, root, {b: f for b, f in known["folders"].items() if b in touched})
    made = _write(old.join(gone, ["bucket", "path"], "left_anti").select("path", "source", "bucket").unionByName(changed), root)
    kept = {b: f for b, f in known["folders"].items() if b not in touched}
    return _publish(root, last + 1, buckets, {**kept, **made})


def expire(root: str, keep: int = 10) -> list[int]:
    """Delete all but the newest ``keep`` versions and the folders that only they use; the numbers deleted."""
    from pyarrow import fs

    known = versions(root)
    old, rest = known[: -max(1, keep)], known[-max(1, keep) :]
    used = {f for v in rest for f in manifest(root, v)["folders"].values()}
    unused = {f for v in old for f in manifest(root, v)["folders"].values()} - used
    store, inner = _store(root)
    for v in old:
        store.delete_file(f"{inner}/versions/{v}")
    for folder in sorted(unused):
        if store.get_file_info(f"{inner}/{folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{inner}/{folder}")
    return old
