"""Text cleaning as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from annospark.functions.binding import let

ROUNDS = 10

# The characters that count as blank at the edges of a text, and the
# five artefact patterns, applied in this order on every round.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_ARTEFACTS = [
    r"(?mdU)^```[a-zA-Z]*\s*\n?",
    r"(?mdU)^```\s*\n?",
    r"(?mdU)\n?\s*```$",
    r"(?U)\A`+\s*",
    r"(?dU)\s*`+\Z",
]


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode blanks included."""
    return F.btrim(col, F.lit(BLANKS))


def head_lines(col: Column, n: int) -> Column:
    """First ``n`` lines of a text."""
    return F.substring_index(col, "\n", n)


def _between(col: Column, quote: str) -> Column:
    n = len(quote)
    return F.substring(col, F.lit(n + 1), F.greatest(F.length(col) - 2 * n, F.lit(0)))


def _wrapped(col: Column, quote: str) -> Column:
    return col.startswith(quote) & col.endswith(quote)


def unquote(col: Column) -> Column:
    """Remove one pair of matching outer triple quotes, then edge blanks."""
    return let(
        strip(col),
        lambda bare: F.when(_wrapped(bare, '"""'), strip(_between(bare, '"""')))
        .when(_wrapped(bare, "'''"), strip(_between(bare, "'''")))
        .otherwise(bare),
    )


def strip_fences(col: Column) -> Column:
    """One round of code-fence and edge-backtick removal."""
    for pattern in _ARTEFACTS:
        col = F.regexp_replace(col, pattern, "")
    return strip(col)


def clean(col: Column, rounds: int = ROUNDS) -> Column:
    """Answer text without quotes and code fences.

    Fences are removed until nothing changes, at most ``rounds`` times.  A text
    without a backtick skips the rounds.
    """
    def unfenced(bare: Column) -> Column:
        done = F.aggregate(
            F.sequence(F.lit(1), F.lit(rounds)),
            bare,
            lambda acc, _: F.when(acc.contains("`"), strip_fences(acc)).otherwise(acc),
        )
        return F.when(bare.contains("`"), done).otherwise(bare)

    return unquote(let(unquote(col), unfenced))


def clean_existing(col: Column) -> Column:
    """Text of a string literal: prefix, outer quotes and edge blanks removed."""
    code = F.regexp_replace(strip(col), "^[rRbBuU]{1,2}(?=[\"'])", "")
    return strip(
        F.when(_wrapped(code, '"""'), _between(code, '"""'))
        .when(_wrapped(code, "'''"), _between(code, "'''"))
        .when(_wrapped(code, '"'), _between(code, '"'))
        .when(_wrapped(code, "'"), _between(code, "'"))
        .otherwise(code)
    )


def quote(col: Column) -> Column:
    """Docstring literal: one pair of outer triple quotes dropped, then wrapped."""
    inner = let(
        strip(col),
        lambda bare: F.when(_wrapped(bare, '"""'), _between(bare, '"""'))
        .when(_wrapped(bare, "'''"), _between(bare, "'''"))
        .otherwise(bare),
    )
    return F.concat(F.lit('"""'), inner, F.lit('"""'))


#: Escapes that Python reads whatever follows; a named character may not exist, so it is not one.
_ESCAPE = r"(?s)\\(?:[^xuUN]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4})"


def quotable(literal: Column) -> Column:
    """True when the result of ``quote`` is one Python literal: nothing inside closes it
    early, joins its closing quotes, escapes them or is an escape that Python rejects."""
    def sound(inner: Column) -> Column:
        return ~(inner.contains("\\") | inner.contains('"""') | inner.endswith('"') | inner.contains("\x00"))

    return let(F.regexp_replace(_between(literal, '"""'), _ESCAPE, "_"), sound)
