"""Style checks of answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from annospark.functions.binding import let
from annospark.functions.lexical import unix_newlines
from annospark.functions.text import strip

# The styles and the section names each of them knows.
STYLES = ("google", "numpy", "sphinx")
GOOGLE_ENTRY_SECTIONS = (
    "Arguments", "Args", "Parameters", "Params", "Raises", "Exceptions", "Except",
    "Attributes",
)
GOOGLE_TEXT_SECTIONS = (
    "Example", "Examples", "Returns", "Yields",
)
NUMPY_SECTIONS = (
    "Parameters", "Params", "Arguments", "Args", "Other Parameters", "Other Params",
    "Other Arguments", "Other Args", "Receives", "Receive", "Raises", "Raise", "Warns",
    "Warn", "Attributes", "Attribute", "Returns", "Return", "Yields", "Yield",
    "Examples", "Example", "Warnings", "Warning", "See Also", "Related", "Notes",
    "Note", "References", "Reference",
)

MISSING_DESCRIPTION = "Missing short description"

_FIRST_SECTION = {
    "google": rf"(?m)^(?:{'|'.join(GOOGLE_ENTRY_SECTIONS + GOOGLE_TEXT_SECTIONS)}):[ \t\r]*$",
    "numpy": rf"(?m)^(?:{'|'.join(NUMPY_SECTIONS)})[ \t]*\n[ \t]*-{{2,}}[ \t]*$",
    "sphinx": r"(?m)^:",
}
# An entry section's block: the indented or blank lines below its title.
_GOOGLE_BLOCK = (
    rf"(?m)^(?:{'|'.join(GOOGLE_ENTRY_SECTIONS)}):[ \t\r]*\n((?:[ \t]+[^\n]*(?:\n|\z)|[ \t]*\n)+)"
)


def dedented(col: Column) -> Column:
    """Text with edge blanks removed and the indent shared by lines after the first
    taken off, as documentation tools read it."""
    bare = strip(unix_newlines(col))
    # Lines after the first that are not blank, by their leading blanks.
    leads = F.regexp_extract_all(bare, F.lit(r"\n([ \t]*+)(?=[^\s])"), F.lit(1))
    margin = F.coalesce(F.array_min(F.transform(leads, lambda b: F.length(b))), F.lit(0))
    indented = bare.contains("\n ") | bare.contains("\n\t")

    def shifted(b: Column) -> Column:
        lines = F.transform(
            F.split(b["bare"], "\n"),
            lambda l, i: F.when(i == 0, l).otherwise(F.substring(l, b["margin"] + 1, F.length(l))),
        )
        return F.when(b["margin"] == 0, b["bare"]).otherwise(F.array_join(lines, "\n"))

    measured = F.when(indented, margin).otherwise(F.lit(0))
    return let(F.struct(bare.alias("bare"), measured.alias("margin")), shifted)


def short_description(col: Column, style: str) -> Column:
    """Text before the first section of the style."""
    return strip(F.get(F.split(dedented(col), _FIRST_SECTION[style], 2), F.lit(0)))


def _google_fault(col: Column) -> Column:
    """First entry of an argument-like section without a colon."""
    blocks = F.regexp_extract_all(dedented(col), F.lit(_GOOGLE_BLOCK), F.lit(1))

    def entries(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda l: F.trim(l) != "")
        return let(
            F.length(F.regexp_extract(block, r"\A(?:[ \t]*\n)*([ \t]+)", 1)),
            lambda margin: F.filter(
                lines, lambda l: F.length(F.regexp_extract(l, r"^[ \t]*", 0)) <= margin
            ),
        )

    faults = F.filter(F.flatten(F.transform(blocks, entries)), lambda l: ~l.contains(":"))
    return F.trim(F.get(faults, F.lit(0)))


def _sphinx_fault(col: Column) -> Column:
    """First field line whose field name is not closed by a colon."""
    fields = F.regexp_extract_all(dedented(col), F.lit(r"(?m)^:[^\n]*"), F.lit(0))
    return F.get(F.filter(fields, lambda l: ~F.substring(l, 2, 2**31 - 1).contains(":")), F.lit(0))


def validate(col: Column, style: str) -> Column:
    """``struct(valid, error)``: is there a short description, are sections readable?

    The check covers the section shapes of each style, not a full grammar.
    """
    if style not in STYLES:
        raise ValueError(f"Unsupported style: {style}. Must be one of: {', '.join(STYLES)}")
    fault = {"google": _google_fault, "sphinx": _sphinx_fault}.get(style)
    error = F.when(F.coalesce(strip(col), F.lit("")) == "", MISSING_DESCRIPTION).when(
        short_description(col, style) == "", MISSING_DESCRIPTION
    )
    if fault is not None:
        found = fault(col)
        error = error.when(
            found.isNotNull(), F.concat(F.lit("Parse error: malformed entry: "), found)
        )
    return F.struct(error.isNull().alias("valid"), error.alias("error"))


def validate_by_style(col: Column, style: Column) -> Column:
    """``validate`` with the style taken from a column."""
    result = F.when(F.lit(False), validate(col, STYLES[0]))
    for name in STYLES:
        result = result.when(style == name, validate(col, name))
    unknown = F.concat(F.lit("Unknown style: "), style)
    return result.otherwise(F.struct(F.lit(False).alias("valid"), unknown.alias("error")))
