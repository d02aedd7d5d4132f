"""Column expressions that turn source text into text a plain regex can read.

Scanning code with regexes goes wrong inside strings, comments and brackets.
So the characters that matter to the scanner are swapped, inside those regions
only, for Unicode noncharacters (code points reserved for internal use).  The
swap is one to one: ``show`` gives the original text back.  What is left visible
after ``veil``:

* ``\\n``  ends a logical line (never inside a string, bracket or continuation)
* ``:`` ``;``  stand at bracket depth 0
* ``#``  starts a comment
* ``"`` ``'``  start a string that never ends
* ``LONE``  stands before a bracket that has no partner

Everything is a native expression on one row, so a file is scanned where it is
read and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters hidden inside strings, comments and backslash continuations.
_STRING_CHARS = "\"'#\\\n()[]{},:;=*/>"
_STRING_SWAP = "".join(chr(0xFDD0 + i) for i in range(len(_STRING_CHARS)))
# Characters hidden inside balanced brackets.
_BRACKET_CHARS = "\n:;"
_BRACKET_SWAP = "".join(chr(0xFDE4 + i) for i in range(len(_BRACKET_CHARS)))
# Marks: end of a string literal, bracket without a partner.
END = chr(0xFDEE)
LONE = chr(0xFDEF)

# Such characters in the source itself: each gets GUARD before it and is swapped for a
# stand-in, so that it means nothing to the scanner; ``show`` undoes this as well.
GUARD = chr(0x10FFFE)
_MARKS = "".join(chr(c) for c in range(0xFDD0, 0xFDF0))
_STAND_INS = "".join(chr(0x10FF00 + i) for i in range(len(_MARKS)))
_TO_GUARD = f"[{_MARKS[0]}-{_MARKS[-1]}{GUARD}]"
STRING_NEWLINE = _STRING_SWAP[_STRING_CHARS.index("\n")]
BRACKET_NEWLINE = _BRACKET_SWAP[0]
CONTINUATION = _STRING_SWAP[3] + STRING_NEWLINE
_DOUBLE, _SINGLE, _BACKSLASH = _STRING_SWAP[0], _STRING_SWAP[1], _STRING_SWAP[3]

# Possessive, unrolled forms: the Java matcher stays iterative on long input.
_TOKENS = "(?s)" + "|".join(
    [
        r'"{3}[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"{3}',
        r"'{3}[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'{3}",
        r'"{3}',
        r"'{3}",
        r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"',
        r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'",
        r"#[^\n]*+",
        r"\\\n",
        r"[^\"'#\\]++",
        r".",
    ]
)

# CPython refuses deeper nesting than this, so the pattern covers all valid code.
MAX_NESTING = 200


def bracket_group(depth: int = MAX_NESTING) -> str:
    """Regex for one balanced bracket group nested up to ``depth`` levels."""
    plain = r"[^()\[\]{}]*+"
    group = rf"[(\[{{]{plain}[)\]}}]"
    for _ in range(depth - 1):
        group = rf"[(\[{{]{plain}(?:{group}{plain})*+[)\]}}]"
    return group


GROUP = bracket_group()
_BRACKETS = rf"(?s)[^()\[\]{{}}]++|{GROUP}|."

# A string literal in veiled text, and blanks that may stand between literals.
_QUOTE = f"[{_DOUBLE}{_SINGLE}]"
STRING = f"{_QUOTE}[^{END}]*+{END}"
GAP = rf"(?:[\s{STRING_NEWLINE}{BRACKET_NEWLINE}{_BACKSLASH}]|#[^\n{BRACKET_NEWLINE}]*+)*+"


def unix_newlines(source: Column) -> Column:
    """Universal newlines, as a text-mode read would give them."""
    return F.when(source.contains("\r"), F.regexp_replace(source, "\r\n?", "\n")).otherwise(source)


def tokens(source: Column) -> Column:
    """Array of strings, comments, continuations and the code between them."""
    return F.regexp_extract_all(source, F.lit(_TOKENS), F.lit(0))


def veil_strings(source: Column) -> Column:
    """Hide what strings, comments and backslash continuations contain."""

    def one(token: Column) -> Column:
        first = F.substring(token, 1, 1)
        hidden = F.translate(token, _STRING_CHARS, _STRING_SWAP)
        is_string = first.isin('"', "'") & (F.length(token) > 1) & ~token.isin('"""', "'''")
        return (
            F.when(is_string, F.concat(hidden, F.lit(END)))
            .when(first == "#", F.concat(F.lit("#"), F.substring(hidden, 2, 2**31 - 1)))
            .when(token == "\\\n", hidden)
            .otherwise(token)
        )

    return F.array_join(F.transform(tokens(source), one), "")


def veil_brackets(text: Column) -> Column:
    """Hide line ends, colons and semicolons inside balanced brackets."""

    def one(piece: Column) -> Column:
        opens = F.substring(piece, 1, 1).isin("(", "[", "{", ")", "]", "}")
        return (
            F.when(opens & (F.length(piece) > 1), F.translate(piece, _BRACKET_CHARS, _BRACKET_SWAP))
            .when(opens, F.concat(F.lit(LONE), piece))
            .otherwise(piece)
        )

    pieces = F.regexp_extract_all(text, F.lit(_BRACKETS), F.lit(0))
    return F.array_join(F.transform(pieces, one), "")


def open_brackets(text: Column) -> Column:
    """Undo ``veil_brackets`` only; strings and comments stay hidden."""
    return F.translate(text, _BRACKET_SWAP, _BRACKET_CHARS)


def guard(source: Column) -> Column:
    """Source whose own noncharacters are out of the scanner's way."""
    apart = F.regexp_replace(source, f"({_TO_GUARD})", f"{GUARD}$1")
    return F.when(source.rlike(_TO_GUARD), F.translate(apart, _MARKS, _STAND_INS)).otherwise(source)


def guarded_code(strings: Column) -> Column:
    """Does a guarded character stand outside strings and comments?  Takes veiled strings."""
    return strings.contains(GUARD) & F.regexp_replace(strings, rf"{STRING}|#[^\n]*+", "").contains(GUARD)


def _unguarded(text: Column) -> Column:
    def one(piece: Column) -> Column:
        plain = F.translate(F.substring(piece, 2, 1), _STAND_INS, _MARKS)
        return F.when(piece.startswith(GUARD), plain).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s){GUARD}.|[^{GUARD}]++"), F.lit(0))
    return F.when(text.contains(GUARD), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def show(text: Column) -> Column:
    """Original text of a veiled piece."""
    return _unguarded(
        F.translate(text, _STRING_SWAP + _BRACKET_SWAP + END + LONE, _STRING_CHARS + _BRACKET_CHARS)
    )


def newline_count(text: Column) -> Column:
    """Number of line ends hidden in a logical line."""
    marks = STRING_NEWLINE + BRACKET_NEWLINE
    return F.length(text) - F.length(F.translate(text, marks, ""))


def bare(line: Column) -> Column:
    """A logical line without its leading blanks."""
    return F.ltrim(line, F.lit(" \t\f"))


def indent_width(line: Column, bare_line: Column) -> Column:
    """Columns of leading blanks; a tab moves to the next multiple of eight."""
    lead = F.length(line) - F.length(bare_line)
    tabbed = F.regexp_replace(
        F.substring(line, F.lit(1), lead), r"\G((?: {8})*) {0,7}\t", "$1        "
    )
    return F.when(line.contains("\t"), F.length(tabbed)).otherwise(lead)
