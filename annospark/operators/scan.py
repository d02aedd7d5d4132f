"""Function and class records of a corpus of Python files.

``(path, source)`` rows become one row per ``def`` or ``class``.  A file is read,
cut into logical lines and resolved to records inside its own row; the first
row-multiplying step is the explode of finished headers.  No step here shuffles,
so the work spreads with the scan, whatever the sizes or names of the files.

Known limits (not a full grammar): f-strings that reuse their own quote inside a
replacement field, and bracket pairs of different kinds, are not told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from annospark.functions import lexical as lx
from annospark.functions.binding import let, settled
from annospark.functions.cached import per_context
from annospark.functions.text import clean_existing, head_lines, strip

_HEADER = r"(?U)^\s*+(?:(?:async\s++)?+def|class)\b"
_GOOD_HEADER = (
    r"(?sU)^\s*+(?:(?:async\s++)?+def\s++\w++\s*+[\[(].*?:|class\s++\w++\s*+[\[(:].*)"
)
_NAME = r"(?U)^\s*+(?:async\s++)?+(?:def|class)\s++(\w++)"
_PLAIN_STRING = rf"[rRbBuU]{{0,2}}{lx.STRING}"
_ANY_STRING = rf"[A-Za-z]{{0,2}}{lx.STRING}"
_LITERAL = rf"(?:{_PLAIN_STRING}|{_ANY_STRING}(?:{lx.GAP}{_ANY_STRING})++)"
# First statement of a body that is a docstring: group 1 is the literal itself.
_DOCSTRING = rf"(?s)^\s*+((?:\({lx.GAP})*+{_LITERAL}(?:{lx.GAP}\))*+)\s*+(?:[;#].*)?$"

PREVIEW_LINES = 5


def _is_doc(text: Column) -> Column:
    return text.rlike(_DOCSTRING)


def tokens(files: DataFrame) -> DataFrame:
    """``path, pos, kind, token``: strings, comments, continuations and what is between."""
    first = F.substring("token", 1, 1)
    kind = (
        F.when(F.col("token").isin('"', "'", '"""', "'''"), "open string")
        .when(first.isin('"', "'"), "string")
        .when(first == "#", "comment")
        .when(F.col("token") == "\\\n", "continuation")
        .otherwise("code")
    )
    # The outer form: for an inner explode Catalyst would tokenise twice, once to filter.
    split = F.posexplode_outer(lx.tokens(lx.unix_newlines(F.col("source")))).alias("pos", "token")
    found = files.select("path", split).where(F.col("pos").isNotNull())
    return found.select("path", "pos", kind.alias("kind"), "token")


@per_context
def _veil_columns() -> tuple[Column, Column, Column]:
    source, strings = F.col("source"), F.col("_strings")
    fault = F.when(strings.isNull(), "unreadable source").when(
        lx.guarded_code(strings), "reserved character"
    )
    return lx.veil_strings(lx.guard(lx.unix_newlines(source))), lx.veil_brackets(strings), fault


def veiled(files: DataFrame) -> DataFrame:
    """Adds ``text``, the source with strings, comments and brackets veiled, and
    ``fault``, why it cannot be scanned at all."""
    strings, brackets, fault = _veil_columns()
    keep = [c for c in files.columns if c != "source"]
    return files.select(*keep, strings.alias("_strings")).select(
        *keep, fault.alias("fault"), brackets.alias("text")
    )


@per_context
def _line_columns() -> tuple[Column, Column]:
    physical = F.split(F.col("text"), f"\n|(?=[{lx.STRING_NEWLINE}{lx.BRACKET_NEWLINE}])")
    goes_on = (lx.STRING_NEWLINE, lx.BRACKET_NEWLINE)
    starts = F.filter(
        F.transform(physical, lambda p, i: F.when(~F.substring(p, 1, 1).isin(*goes_on), i + 1)),
        lambda n: n.isNotNull(),
    )
    lines = F.zip_with(
        F.split(F.col("text"), "\n"),
        F.col("_starts"),
        lambda t, n: F.struct(t.alias("text"), n.alias("line")),
    )
    return starts, lines


def logical_lines(files: DataFrame) -> DataFrame:
    """Adds ``lines``: array of (text, line) with ``line`` the first physical line."""
    starts, lines = _line_columns()
    keep = [c for c in files.columns if c != "source"] + ["fault"]
    return (
        veiled(files)
        .select(*keep, "text", starts.alias("_starts"))
        .select(*keep, lines.alias("lines"))
    )


@per_context
def _statement_column() -> Column:
    coded = F.filter(
        F.transform(
            F.col("lines"),
            lambda l, i: F.struct(
                i.alias("at"),
                l["line"].alias("line"),
                l["text"].alias("text"),
                lx.bare(l["text"]).alias("bare"),
            ),
        ),
        lambda l: (l["bare"] != "") & ~l["bare"].startswith("#"),
    )
    return F.transform(
        coded,
        lambda s: F.struct(
            s["at"].alias("at"),
            s["line"].alias("line"),
            s["text"].alias("text"),
            s["bare"].alias("bare"),
            lx.indent_width(s["text"], s["bare"]).alias("indent"),
            _is_header(s["bare"]).alias("header"),
        ),
    )


def statements(files: DataFrame) -> DataFrame:
    """Adds ``stmts``: array of (at, line, text, bare, indent, header), code lines only."""
    return logical_lines(files).withColumn("stmts", _statement_column())


def _is_header(bare: Column) -> Column:
    quick = bare.startswith("def") | bare.startswith("class") | bare.startswith("async")
    return quick & bare.rlike(_HEADER)


_COLON_COMMENT = rf":[ \t]*+#[^{lx.BRACKET_NEWLINE}]*+$"


def _opens_block(text: Column) -> Column:
    ends = F.rtrim(text).endswith(":")
    return F.when(text.contains("#"), ends | text.rlike(_COLON_COMMENT)).otherwise(ends)


def _problem(s: Column, after: Column) -> Column:
    """What is wrong with one statement, or null."""
    text = s["text"]
    opens = _opens_block(text)
    deeper = F.coalesce(after["indent"] > s["indent"], F.lit(False))
    return (
        F.when(text.contains('"') | text.contains("'"), "unterminated string")
        .when(text.contains(lx.LONE), "unbalanced bracket")
        .when(s["header"] & ~text.rlike(_GOOD_HEADER), "invalid header")
        .when(opens & ~deeper, "expected an indented block")
        .when(deeper & ~opens, "unexpected indent")
    )


@per_context
def _status_columns() -> tuple[Column, Column]:
    stmts = F.col("stmts")
    first_bad = F.get(
        F.filter(
            F.transform(
                stmts, lambda s, i: F.when(_problem(s, F.get(stmts, i + 1)).isNotNull(), i)
            ),
            lambda i: i.isNotNull(),
        ),
        F.lit(0),
    )
    bad, after = F.get(stmts, F.col("_bad")), F.get(stmts, F.col("_bad") + 1)
    fault = F.struct(F.lit(0).alias("line"), F.col("fault").alias("error"))
    found = F.struct(bad["line"].alias("line"), _problem(bad, after).alias("error"))
    problem = F.when(F.col("fault").isNotNull(), fault).when(F.col("_bad").isNotNull(), found)
    return first_bad, problem


def _with_status(stmts: DataFrame) -> DataFrame:
    first_bad, problem = _status_columns()
    return stmts.withColumn("_bad", first_bad).withColumn("problem", problem)


def parse_status(files: DataFrame) -> DataFrame:
    """One row per file: the caller's columns, ``error_line`` and ``error``; a null
    error means readable.

    Finds unterminated strings, unbalanced brackets, ``def``/``class`` lines that
    are not headers, headers without a body and stray indents.
    """
    keep = [c for c in files.columns if c != "source"]
    found = _with_status(statements(files)).select(*keep, "problem")
    return settled(found, "problem").select(
        *keep, F.col("problem.line").alias("error_line"), F.col("problem.error").alias("error")
    )


@per_context
def _scopes_column() -> Column:
    """Innermost enclosing class per header.

    The stack of open classes is folded over the headers of one top-level
    definition at a time.  The fold notes only where the innermost class changes, so
    a class of many methods adds one note, not one for each of them.
    """
    headers = F.col("_headers")
    empty = F.struct(
        F.expr("cast(array() as array<struct<indent:int,name:string>>)").alias("open"),
        F.expr("cast(array() as array<struct<at:int,name:string>>)").alias("runs"),
        F.lit(0).alias("at"),
    )

    def step(acc: Column, h: Column) -> Column:
        still = F.filter(acc["open"], lambda c: c["indent"] < h["low"])
        entry = F.struct(h["indent"].alias("indent"), h["name"].alias("name"))
        runs, owner = acc["runs"], F.get(still, F.size(still) - 1)["name"]
        same = (acc["at"] > 0) & F.get(runs, F.size(runs) - 1)["name"].eqNullSafe(owner)
        begun = F.struct(acc["at"].alias("at"), owner.alias("name"))
        return F.struct(
            F.when(h["is_class"], F.concat(still, F.array(entry))).otherwise(still).alias("open"),
            F.when(same, runs).otherwise(F.concat(runs, F.array(begun))).alias("runs"),
            (acc["at"] + 1).alias("at"),
        )

    def spread(acc: Column) -> Column:
        runs = acc["runs"]
        until = lambda i: F.coalesce(F.get(runs, i + 1)["at"], acc["at"])
        return F.flatten(F.transform(runs, lambda r, i: F.array_repeat(r["name"], until(i) - r["at"])))

    heads = F.filter(
        F.transform(headers, lambda h, i: F.when((i == 0) | (h["low"] == 0), i)),
        lambda i: i.isNotNull(),
    )
    blocks = let(
        heads,
        lambda begins: F.transform(
            begins,
            lambda start, b: F.slice(
                headers, start + 1, F.coalesce(F.get(begins, b + 1), F.size(headers)) - start
            ),
        ),
    )
    return F.flatten(F.transform(blocks, lambda b: F.aggregate(b, empty, step, spread)))


@per_context
def _header_columns() -> tuple[Column, Column]:
    stmts, places = F.col("stmts"), F.col("_at")
    at = F.filter(
        F.transform(stmts, lambda s, i: F.when(s["header"], i)), lambda i: i.isNotNull()
    )

    def header(i: Column, n: Column) -> Column:
        this, after = F.get(stmts, i), F.get(stmts, i + 1)
        documented = (after["indent"] > this["indent"]) & _is_doc(after["text"])
        first = F.when(documented, i + 1).otherwise(i)
        return let(first, lambda f: resolved(i, n, f))

    def resolved(i: Column, n: Column, first: Column) -> Column:
        this, place = F.get(stmts, i), F.get(stmts, first)["at"]
        since = F.coalesce(F.get(places, n - 1), F.lit(-1)) + 1
        return F.struct(
            this["line"].alias("line_number"),
            this["indent"].alias("indent"),
            F.regexp_extract(this["bare"], _NAME, 1).alias("name"),
            this["bare"].startswith("class").alias("is_class"),
            F.array_min(
                F.transform(F.slice(stmts, since + 1, i - since + 1), lambda s: s["indent"])
            ).alias("low"),
            this["text"].alias("text"),
            F.get(stmts, i + 1).alias("after"),
            place.alias("first"),
            F.transform(
                F.slice(stmts, first + 2, PREVIEW_LINES),
                lambda s: F.struct(s["at"].alias("at"), s["indent"].alias("indent")),
            ).alias("inside"),
            F.slice(F.col("lines"), place + 2, PREVIEW_LINES).alias("body"),
        )

    return F.when(F.col("problem").isNull(), at), F.transform(places, header)


def headers(files: DataFrame) -> DataFrame:
    """One row per ``def``/``class`` of every file, plus one null row (``line_number``
    null) for a file that has none or cannot be read.

    Columns beside the caller's (without ``source``): ``error_line, error`` of the
    file, ``nth`` (0 on exactly one row per file) and, for a header, ``line_number,
    indent, name, is_class, parent_class, text`` (veiled header), ``after`` (next
    statement) and what the preview needs.
    """
    keep = [c for c in files.columns if c != "source"]
    at, found = _header_columns()
    per_file = (
        _with_status(statements(files))
        .select(*keep, "lines", "stmts", "problem", at.alias("_at"))
        .select(*keep, "problem", found.alias("_headers"))
        .select(*keep, "problem", F.arrays_zip("_headers", _scopes_column().alias("_scopes")).alias("_zip"))
    )
    status = [F.col("problem.line").alias("error_line"), F.col("problem.error").alias("error")]
    return (
        settled(per_file, "problem", "_zip")
        .select(*keep, *status, F.posexplode_outer("_zip").alias("nth", "h"))
        .select(
            *keep, "error_line", "error", F.coalesce("nth", F.lit(0)).alias("nth"),
            "h._headers.*", F.col("h._scopes").alias("parent_class"),
        )
    )


def _signature_parts(text: Column) -> tuple[Column, Column]:
    head = F.regexp_extract(text, r"(?s)^([^:]*+):", 1)
    arrow = F.locate("->", head)
    left = F.when(arrow > 0, F.substring(head, F.lit(1), arrow - 1)).otherwise(head)
    right = F.when(arrow > 0, F.substring(head, arrow + 2, F.length(head)))
    inner = F.regexp_extract(
        left, r"(?sU)^\s*+(?:async\s++)?+def\s++\w++\s*+(?:\[.*?\]\s*+)?\((.*)\)\s*+$", 1
    )
    return inner, right


def parameters(inner: Column) -> Column:
    """(name, type_hint) of a veiled parameter list.

    Order: plain and keyword-only parameters, then ``*args``, then ``**kwargs``;
    the bare ``*`` and ``/`` separators and default values are left out.
    """
    text = F.regexp_replace(inner, f"#[^{lx.BRACKET_NEWLINE}]*+", "")
    parts = F.regexp_extract_all(
        lx.open_brackets(text), F.lit(rf"(?:[^,()\[\]{{}}]++|{lx.GROUP})++"), F.lit(0)
    )
    lead = rf"^(?:\s|{lx.CONTINUATION})++"
    parts = F.transform(parts, lambda p: strip(F.regexp_replace(p, lead, "")))
    # a comma between the arguments of a default's lambda parts nothing
    parts = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            F.coalesce(F.try_element_at(acc, F.lit(-1)).rlike(r"(?s)=.*\blambda\b[^:]*+$"), F.lit(False)),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.concat_ws(", ", F.try_element_at(acc, F.lit(-1)), p)),
            ),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    parts = F.filter(parts, lambda p: ~p.isin("", "*", "/"))
    ordered = let(
        parts,
        lambda given: F.concat(
            F.filter(given, lambda p: ~p.startswith("*")),
            F.filter(given, lambda p: p.startswith("*") & ~p.startswith("**")),
            F.filter(given, lambda p: p.startswith("**")),
        ),
    )

    def one(p: Column) -> Column:
        hint = F.regexp_extract(
            p, rf"(?sU)^\**+\s*+\w++\s*+:((?:[^=()\[\]{{}}]++|{lx.GROUP})++)", 1
        )
        hint = strip(lx.show(hint))
        return F.struct(
            F.regexp_replace(F.regexp_extract(p, r"(?U)^\**+\s*+\w++", 0), r"\s", "").alias("name"),
            F.when(hint != "", hint).alias("type_hint"),
        )

    return F.transform(ordered, one)


def _preview(indent: Column, first: Column, inside: Column, body: Column) -> Column:
    """Up to five lines after the header and docstring, without the body indent."""
    left_at = F.get(
        F.filter(
            F.transform(inside, lambda s, i: F.when(s["indent"] <= indent, i)),
            lambda i: i.isNotNull(),
        ),
        F.lit(0),
    )
    count = F.coalesce(left_at, F.size(inside))
    last = F.get(inside, count - 1)["at"]
    margin = F.get(inside, F.lit(0))["indent"]
    lines = F.slice(body, 1, F.greatest(F.coalesce(last - first, F.lit(0)), F.lit(0)))

    def dedent(line: Column) -> Column:
        lead = F.length(F.regexp_extract(line, r"^[ \t]*+", 0))
        return F.substring(line, F.least(lead, margin) + 1, F.length(line))

    physical = F.split(
        F.array_join(F.transform(lines, lambda l: l["text"]), "\n"),
        f"\n|{lx.BRACKET_NEWLINE}",
    )
    text = F.array_join(F.transform(physical, dedent), "\n")
    return F.when(count > 0, head_lines(F.rtrim(lx.show(text)), PREVIEW_LINES)).otherwise("")


@per_context
def _record_columns() -> dict[str, Column]:
    text, after = F.col("text"), F.col("after")
    inner, returns = _signature_parts(text)
    tail = strip(F.regexp_extract(text, r"(?s)^[^:]*+:(.*)$", 1))
    deeper = F.coalesce(after["indent"] > F.col("indent"), F.lit(False))
    literal = lx.show(F.regexp_extract(after["text"], _DOCSTRING, 1))
    rest = strip(lx.show(F.regexp_extract(after["text"], r"(?s);(.*)$", 1)))
    return_type = strip(lx.show(returns))
    documented = F.col("has_docstring")
    preview = _preview(F.col("indent"), F.col("first"), F.col("inside"), F.col("body"))
    return {
        "one_line": (tail != "") & ~tail.startswith("#"),
        "has_docstring": ~F.col("one_line") & deeper & F.coalesce(_is_doc(after["text"]), F.lit(False)),
        "docstring_raw": F.when(documented, literal),
        "existing_docstring": clean_existing(F.col("docstring_raw")),
        "params": parameters(inner),
        "return_type": F.when(return_type != "", return_type),
        "body_preview": F.when(F.col("one_line"), "").otherwise(preview),
        "header_end": F.col("line_number") + lx.newline_count(text),
        "doc_end": F.when(documented, after["line"] + lx.newline_count(after["text"])),
        "doc_rest": F.when(documented, rest),
        "body_indent": lx.show(F.regexp_extract(after["text"], r"^[ \t]*+", 0)),
    }


def records(headed: DataFrame) -> DataFrame:
    """Adds the readable columns to ``headers`` rows; unused ones are pruned."""
    columns = dict(_record_columns())
    first = {"one_line": columns.pop("one_line")}
    second = {"has_docstring": columns.pop("has_docstring")}
    third = {"docstring_raw": columns.pop("docstring_raw")}
    for step in (first, second, third, columns):
        headed = headed.withColumns(step)
    return headed


_FUNCTION_COLUMNS = [
    "name", "params", "return_type", "body_preview", "has_docstring",
    "existing_docstring", "line_number", "parent_class",
]


def functions(files: DataFrame) -> DataFrame:
    """Function records of all readable files, methods and inner functions included."""
    keep = [c for c in files.columns if c != "source"]
    found = headers(files).where(F.col("line_number").isNotNull() & ~F.col("is_class"))
    return records(found).select(*keep, *_FUNCTION_COLUMNS)


_SITE_COLUMNS = ["one_line", "docstring_raw", "header_end", "doc_end", "doc_rest", "body_indent"]


def scanned(files: DataFrame) -> DataFrame:
    """All that one pass over the source gives: every file with its status, every
    function with its record and the place of its docstring.  Small beside the
    source; write it once where several results need it."""
    keep = [c for c in files.columns if c != "source"]
    return records(headers(files)).select(
        *keep, "error_line", "error", "nth", "is_class", *_FUNCTION_COLUMNS, *_SITE_COLUMNS
    )


def sites_of(scan_rows: DataFrame) -> DataFrame:
    """Function rows of ``scanned``."""
    return scan_rows.where(F.col("line_number").isNotNull() & ~F.col("is_class")).drop(
        "error_line", "error", "nth", "is_class"
    )


def status_of(scan_rows: DataFrame) -> DataFrame:
    """File rows of ``scanned``: ``path, error_line, error``."""
    return scan_rows.where(F.col("nth") == 0).select("path", "error_line", "error")


def function_sites(files: DataFrame) -> DataFrame:
    """Where each function's docstring is or would go; input of ``merge.inject``."""
    return sites_of(scanned(files))


def classes(files: DataFrame) -> DataFrame:
    """Class records of all readable files."""
    keep = [c for c in files.columns if c != "source"]
    found = headers(files).where(F.col("line_number").isNotNull() & F.col("is_class"))
    return records(found).select(
        *keep, "name", "has_docstring", "existing_docstring", "line_number", "parent_class"
    )


def class_methods(functions_df: DataFrame, classes_df: DataFrame) -> DataFrame:
    """Classes with their methods nested in line order.

    A method belongs to the nearest class of its name above it in the file, so a
    name that is defined twice keeps its two sets of methods apart.
    """
    start = classes_df.select(
        "path", F.col("name").alias("parent_class"), F.col("line_number").alias("class_line")
    )
    marked = start.withColumn("at", F.col("class_line")).unionByName(
        functions_df.where(F.col("parent_class").isNotNull()).select(
            "path", "parent_class", F.col("line_number").alias("at"),
            F.struct("line_number", "name").alias("method"),
        ),
        allowMissingColumns=True,
    )
    upto = Window.partitionBy("path", "parent_class").orderBy("at")
    owned = marked.withColumn("class_line", F.last("class_line", ignorenulls=True).over(upto))
    grouped = owned.groupBy("path", F.col("class_line").alias("line_number")).agg(
        F.array_sort(F.collect_list("method")).alias("methods")
    )
    return classes_df.join(grouped, ["path", "line_number"], "left").withColumn(
        "methods", F.transform(F.coalesce("methods", F.array()), lambda m: m["name"])
    )
