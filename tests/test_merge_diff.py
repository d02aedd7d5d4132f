import ast
import difflib
import io
import random
import textwrap
import time
import tokenize
import warnings

from pyspark.sql import functions as F

from annospark.functions.alignment import align
from annospark.functions.text import quotable, quote
from annospark.operators import diff, merge, scan
from tests.test_scan import random_module

NEW = "path string, name string, parent_class string, docstring string"


def patched(files, new, spark, overwrite=False):
    df = spark.createDataFrame(new, NEW)
    return {r.path: r.source for r in merge.inject(files, df, overwrite, by_name=True).collect()}


def test_insert_replace_and_keep(spark, files):
    source = 'def f(a,\n      b):  # note\n    return a\n\ndef g():\n    """Old\n    text."""\n    return 1\n'
    df = files(source)
    new = [("f0.py", "f", None, '"""New f."""'), ("f0.py", "g", None, "New g.")]
    kept = patched(df, new, spark)["f0.py"]
    assert kept == source.replace("# note\n", '# note\n    """New f."""\n')
    both = patched(df, new, spark, overwrite=True)["f0.py"]
    assert both == kept.replace('"""Old\n    text."""', '"""New g."""')


def test_same_method_name_in_two_classes(spark, files):
    source = textwrap.dedent("""
        class A:
            def method(self):
                return "A"

        class B:
            def method(self):
                return "B"
    """)
    out = patched(files(source), [("f0.py", "method", "B", "In B.")], spark)["f0.py"]
    assert out == source.replace('        return "B"', '        """In B."""\n        return "B"')


def test_statement_after_docstring_is_kept(spark, files):
    out = patched(files('def f():\n    "old"; x = 1\n    return x\n'), [("f0.py", "f", None, "New.")], spark, True)
    assert out["f0.py"] == 'def f():\n    """New."""\n    x = 1\n    return x\n'


def test_body_on_header_line_is_an_error(spark, files):
    df = files("def f(): pass\n")
    new = spark.createDataFrame([("f0.py", "f", None, "New.")], NEW)
    row = merge.edits(merge.targets(scan.function_sites(df), new, by_name=True)).first()
    assert (row.outcome, row.text) == ("error", None)
    assert merge.inject(df, new, by_name=True).first().source == "def f(): pass\n"


def test_inject_into_random_modules(spark):
    """The result parses, carries the new docstrings and keeps all other lines."""
    rng = random.Random(3)
    sources = {f"m{i}": random_module(rng) + "\n" for i in range(120)}
    files = spark.createDataFrame(list(sources.items()), "path string, source string")
    new = scan.functions(files).where(F.col("line_number") % 2 == 1).select(
        "path", "line_number", F.format_string("New %d.\nMore.", "line_number").alias("docstring")
    )
    edit_rows = merge.edits(merge.targets(scan.function_sites(files), new), overwrite=True).cache()
    done = {r.path: r.source for r in merge.apply_all(files, edit_rows).collect()}
    assert set(done) == set(sources)
    diffs = {r.path: r["diff"] for r in diff.unified(files, edit_rows).collect()}
    for path, source in sources.items():
        docs = {}
        for node in ast.walk(ast.parse(done[path])):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                docs[node.lineno] = ast.get_docstring(node)
        lines = [n.lineno for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        assert sum((d or "").startswith("New ") for d in docs.values()) == sum(n % 2 for n in lines)
        if path not in diffs:
            assert done[path] == source
            continue
        assert apply_diff(source, diffs[path]) == done[path]


def apply_diff(source, text):
    """Apply a unified diff, checking every context and removed line."""
    old, out, at = source.split("\n"), [], 0
    for line in text.split("\n")[2:-1]:
        if line.startswith("@@"):
            start = line.split()[1][1:].split(",")
            first = int(start[0]) - (0 if len(start) > 1 and start[1] == "0" else 1)
            out += old[at:first]
            at = first
        elif line[0] == "+":
            out.append(line[1:])
        else:
            assert old[at] == line[1:]
            at += 1
            if line[0] == " ":
                out.append(line[1:])
    return "\n".join(out + old[at:])


def test_unified_equals_difflib_on_plain_edits(spark, files):
    source = "".join(f"def f{i}():\n" + "".join(f"    v{j} = {i * j}\n" for j in range(i)) + "    return 1\n\n" for i in range(12))
    df = files(source)
    new = scan.functions(df).where("line_number % 3 = 1").select("path", "line_number", F.lit("New.").alias("docstring"))
    edit_rows = merge.edits(merge.targets(scan.function_sites(df), new))
    after = merge.apply_edits(df, edit_rows).first().source
    want = "".join(difflib.unified_diff(source.splitlines(True), after.splitlines(True), "a/f0.py", "b/f0.py"))
    assert diff.unified(df, edit_rows).first()["diff"] == want
    flat = diff.unified(df, edit_rows, lineterm="").first()["diff"]
    assert flat == "".join(
        difflib.unified_diff(source.splitlines(True), after.splitlines(True), "a/f0.py", "b/f0.py", lineterm="")
    )


def test_same_docstring_is_no_difference(spark, files):
    df = files('def f():\n    """Same."""\n    return 1\n')
    new = spark.createDataFrame([("f0.py", "f", None, "Same.")], NEW)
    edit_rows = merge.edits(merge.targets(scan.function_sites(df), new, by_name=True), overwrite=True)
    assert diff.unified(df, edit_rows).count() == 0 and diff.line_diff(df, edit_rows).count() == 0


def test_merge_policies_and_null_safe_keys(spark):
    records = spark.createDataFrame([("a", None, "old"), ("b", "C", None), ("c", None, None)], "n string, c string, v string")
    new = spark.createDataFrame([("a", None, "new"), ("b", "C", "new"), ("c", "X", "new")], "n string, c string, w string")
    got = {r.n: (r.merged, r.outcome) for r in merge.merge(records, new, ["n", "c"], "v", "w").collect()}
    assert got == {"a": ("old", "unchanged"), "b": ("new", "added"), "c": (None, "unchanged")}
    got = {r.n: (r.merged, r.outcome) for r in merge.merge(records, new, ["n", "c"], "v", "w", True).collect()}
    assert got["a"] == ("new", "updated")


def test_row_and_keyless_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (4, "w"), (3, "z")], "k int, v string")
    got = {(r.k, r.change) for r in diff.row_diff(a.distinct(), b, "k", "v").collect()}
    assert got == {(1, "changed"), (4, "added")}
    got = {(r.k, r.v, r.sign, r.copies) for r in diff.keyless_diff(a, b).collect()}
    assert got == {(1, "x", "-", 1), (1, "y", "+", 1), (3, "z", "-", 1), (4, "w", "+", 1)}


ODD = ['Say "hi"', 'in """ side', "back\\", "C:\\users\\x", "two\\\\", 'esc \\"', 'a "" b', "\\x4", "\\x41", "\\U0010FFFF", "\\U00110000", "\\N{DASH}", "\\q", "nul \x00", ""]


def test_only_literals_that_python_reads_are_put_in(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice('"\\xuU0aN{}\n ') for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    literal = quote(F.col("t"))
    for r in df.select("t", literal.alias("q"), quotable(literal).alias("ok")).collect():
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                fits = isinstance(ast.literal_eval(r.q), str)
                strings = [t for t in tokenize.generate_tokens(io.StringIO(r.q).readline) if t.type == tokenize.STRING]
                fits = fits and len(strings) == 1
        except (SyntaxError, ValueError):
            fits = False
        assert fits == r.ok or not r.ok and "\\N" in r.t, r


def test_a_docstring_that_breaks_the_file_is_an_error(spark, files):
    df = files("def f():\n    return 1\n")
    for text in ODD:
        new = spark.createDataFrame([("f0.py", "f", None, text)], NEW)
        row = merge.edits(merge.targets(scan.function_sites(df), new, by_name=True)).first()
        after = merge.inject(df, new, by_name=True).first().source
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(after)
        assert (row.outcome == "error") == (after == "def f():\n    return 1\n")
        assert (row.error is None) == (row.outcome == "added")


def lines_of(rng, letters, n):
    return [rng.choice(letters) for _ in range(rng.randrange(n))]


def test_alignment_of_random_lines():
    rng = random.Random(1)
    for _ in range(3000):
        letters = rng.choice(["ab", "abcdefgh", [str(i) for i in range(60)]])
        a = lines_of(rng, letters, 25)
        b = lines_of(rng, letters, 25) if rng.random() < 0.3 else [x for x in a if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice(letters))
        out, at, there = [], 0, 0
        for i, j, k, m in align(a, b):
            assert a[at:i] == b[there:k] and (i < j or k < m) and (i, k) != (at, there) or (i, k) == (0, 0)
            assert not set(a[i:j]) & set(b[k:m])  # no common line is left in a block
            out += a[at:i] + b[k:m]
            at, there = j, m
        assert out + a[at:] == b and a[at:] == b[there:]


def test_alignment_of_long_texts_is_quick_and_small():
    rng = random.Random(2)
    a = [rng.randrange(1 << 40) for _ in range(200_000)]
    b = list(a)
    for _ in range(500):
        b[rng.randrange(len(b))] = rng.randrange(1 << 40)
    start = time.perf_counter()
    assert sum(j - i for i, j, _, _ in align(a, b)) <= 500
    assert time.perf_counter() - start < 10
    same = [1, 2] * 50_000
    assert align(same, same[2:]) == [(99_998, 100_000, 99_998, 99_998)] or len(align(same, same[2:])) == 1


def reversed_diff(text):
    turn = {"+": "-", "-": "+"}
    out = []
    for line in text.split("\n"):
        if line.startswith("@@"):
            _, old, new, _ = line.split(" ")
            line = f"@@ -{new[1:]} +{old[1:]} @@"
        elif line[:1] in turn and line[:4] not in ("--- ", "+++ "):
            line = turn[line[0]] + line[1:]
        out.append(line)
    return "\n".join(out)


def test_two_versions_both_ways(spark):
    rng = random.Random(6)
    rows = []
    for n in range(400):
        letters = rng.choice(["ab", "abcdefgh", [f"line {i}" for i in range(80)]])
        a = lines_of(rng, letters, 60)
        b = [x for x in a if rng.random() < 0.9]
        for _ in range(rng.randrange(5)):
            b.insert(rng.randrange(len(b) + 1), rng.choice(letters))
        rows.append((f"f{n}", "".join(x + "\n" for x in a), "".join(x + "\n" for x in b)))
    df = spark.createDataFrame(rows, "path string, a string, b string")
    changed = diff.compared(df.selectExpr("path", "a AS source"), df.selectExpr("path", "b AS source"))
    texts = {r.path: r["diff"] for r in diff.unified_texts(changed).collect()}
    lines = {}
    for r in diff.line_rows(changed).collect():
        lines.setdefault(r.path, []).append((r.line, r.part, r.sign, r.text))
    for path, a, b in rows:
        if a == b:
            assert path not in texts and path not in lines
            continue
        assert apply_diff(a, texts[path]) == b
        assert apply_diff(b, reversed_diff(texts[path])) == a
        got = sorted(lines[path])
        assert "".join(x[3] + "\n" for x in got if x[2] != "+") == a
        assert "".join(x[3] + "\n" for x in got if x[2] != "-") == b
        # hunks and their headers are difflib's wherever it aligns the same lines
        want = "".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), f"a/{path}", f"b/{path}"))
        if sorted(want.split("\n")) == sorted(texts[path].split("\n")) and "ab" not in a:
            assert len(want) == len(texts[path])


def test_versions_of_any_kind(spark):
    old = [("same", "x\n"), ("gone", "a\nb\n"), ("end", "a\nb"), ("null", None), ("empty", ""), ("crlf", "a\r\nb\r\n"), ("both", "p\nq")]
    new = [("same", "x\n"), ("new", "c\n"), ("end", "a\nb\n"), ("null", "n\n"), ("empty", "e\n"), ("crlf", "a\nb\n"), ("both", "r\nq")]
    make = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "path string, source string, lines int")
    got = {r.path: r["diff"] for r in diff.unified_texts(diff.compared(make(old), make(new))).collect()}
    head = "--- a/{0}\n+++ b/{0}\n".format
    assert got == {
        "gone": head("gone") + "@@ -1,2 +0,0 @@\n-a\n-b\n",
        "new": head("new") + "@@ -0,0 +1 @@\n+c\n",
        "null": head("null") + "@@ -0,0 +1 @@\n+n\n",
        "empty": head("empty") + "@@ -0,0 +1 @@\n+e\n",
        "end": head("end") + "@@ -1,2 +1,2 @@\n a\n-b\n\\ No newline at end of file\n+b\n",
        "both": head("both") + "@@ -1,2 +1,2 @@\n-p\n+r\n q\n\\ No newline at end of file\n",
    }
    assert diff.compared(make(old).limit(0), make(new).limit(0)).count() == 0
