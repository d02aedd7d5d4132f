import os
import random

import pytest

from annospark.operators import rule_index, rules
from annospark.sources import versions


def rows(df):
    return {r.path: r.source for r in df.collect()}


def test_one_changed_file_rewrites_one_bucket(spark, files, tmp_path):
    root = str(tmp_path / "corpus")
    first = {f"a{i}.py": f"x = {i}\n" for i in range(60)}
    table = spark.createDataFrame(list(first.items()), "path string, source string")
    assert versions.create(table, root, buckets=8) == 0
    before = versions.manifest(root)
    assert set(before["folders"]) == set(range(8)) and rows(versions.read(spark, root)) == first

    one = spark.createDataFrame([("a7.py", "y = 1\n"), (None, "lost")], "path string, source string")
    assert versions.commit(one, root) == 1
    after = versions.manifest(root)
    assert sum(after["folders"][b] != before["folders"][b] for b in range(8)) == 1
    assert rows(versions.read(spark, root)) == {**first, "a7.py": "y = 1\n"}
    assert rows(versions.read(spark, root, 0)) == first
    assert rows(versions.read_paths(one, root)) == {"a7.py": "y = 1\n"}

    new = spark.createDataFrame([("new.py", None), ("a1.py", "kept\n")], "path string, source string")
    gone = spark.createDataFrame([("a1.py",), ("a2.py",), ("absent.py",)], "path string")
    versions.commit(new, root, removed=gone)
    want = {**first, "a7.py": "y = 1\n", "new.py": None, "a1.py": "kept\n"}
    want.pop("a2.py")
    assert rows(versions.read(spark, root)) == want
    assert versions.commit(one.limit(0), root) == 2

    assert versions.expire(root, keep=1) == [0, 1]
    assert rows(versions.read(spark, root)) == want and versions.versions(root) == [2]
    with pytest.raises(ValueError):
        versions.read(spark, root, 0)


def test_a_write_that_fails_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "corpus")
    table = spark.createDataFrame([("a.py", "x\n"), ("b.py", "y\n")], "path string, source string")
    versions.create(table, root, buckets=2)
    broken = table.selectExpr("path", "raise_error('lost') AS source")
    with pytest.raises(Exception, match="lost"):
        versions.commit(broken, root)
    assert versions.versions(root) == [0] and rows(versions.read(spark, root)) == {"a.py": "x\n", "b.py": "y\n"}
    gone = table.select("path")
    versions.commit(table.limit(0), root, removed=gone)
    assert rows(versions.read(spark, root)) == {} and rows(versions.read(spark, root, 0)) != {}
    open(os.path.join(root, "versions", "2"), "w").write("{}")
    with pytest.raises(RuntimeError, match="Version 2"):
        versions._publish(root, 2, 2, {})


PARTS = ["a", "b", "src", "build", "x.py", "y.pyc", "test_1.py", "d+", "#n"]
PATTERNS = ["*.pyc", "build/", "/src", "/src/a/", "src/*.py", "**/build", "**/a/**", "a/**/b", "a/*/x.py", "x.py", "[ab]", "/a/b",
            "d+", "src/**", "test_?.py", "**/a/b", r"\#n", "**", "*", "/", "a/b/ ", "src/build/x.py", "**/x.py", "**/**/a", "a//b"]


def test_index_gives_what_the_table_gives(spark):
    rng = random.Random(3)
    lines, paths = [], [(None, "a/b"), ("s0", None)]
    for s in range(40):
        chosen = rng.sample(PATTERNS, rng.randint(1, 6))
        lines += [(f"s{s}", i, ("!" if s % 3 and rng.random() < 0.4 else "") + p) for i, p in enumerate(chosen)]
        paths += [(f"s{s}", "/".join(rng.choices(PARTS, k=rng.randint(1, 5)))) for _ in range(60)]
    paths += [("free", "a/b"), *paths[10:20]]
    rule_rows = spark.createDataFrame(lines, "scope string, seq int, pattern string")
    df = spark.createDataFrame(paths, "scope string, path string")
    got = sorted(map(tuple, rule_index.apply_rule_index(df, rule_rows, ["scope"]).collect()), key=str)
    want = sorted([*map(tuple, rules.apply_rule_table(df.where("path is not null"), rule_rows, ["scope"]).collect()), ("s0", None)], key=str)
    assert got == want


def test_ten_thousand_rules_of_one_scope(spark):
    lines = [("s", i, f"/pkg{i}/gen/" if i % 2 else f"mod_{i}.py") for i in range(10_000)] + [("s", 10_001, "!/keep/**")]
    rule_rows = spark.createDataFrame(lines, "scope string, seq int, pattern string")
    paths = [("s", f"pkg{i}/gen/f.py") for i in range(300)] + [("s", f"z/mod_{i}.py") for i in range(300)] + [("s", "keep/mod_0.py")]
    df = spark.createDataFrame(paths, "scope string, path string")
    kept = {r.path for r in rule_index.apply_rule_index(df, rule_rows, ["scope"]).collect()}
    assert kept == {p for _, p in paths if p.startswith("keep/") or int("".join(filter(str.isdigit, p))) % 2 == (0 if p.startswith("pkg") else 1)}
