"""Ignore-file patterns as regexes, written as column expressions.

On a literal the whole expression folds to a constant, so the matcher compiles the
regex once; on a column the same rules work for a table of patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Stand-ins (Unicode noncharacters) for what a later step must not touch.
_STAR, _MARK, _BRACKET, _OPEN, _SHUT, _SLASHED, _NOT, _DEEP, _TAIL, _ANY = (
    chr(0xFDD0 + i) for i in range(10)
)
# Steps of the translation in order: (regex, replacement).
_STEPS = [
    # escaped characters stand for themselves
    (r"\\\\", _SLASHED),
    (r"\\\*", _STAR),
    (r"\\\?", _MARK),
    (r"\\\[", _BRACKET),
    (r"\\(.)", "$1"),
    # character classes, with what they hold kept literal
    (r"\[[!^](\]?[^\]]*)\]", f"{_OPEN}{_NOT}$1{_SHUT}"),
    (r"\[(\]?[^\]]*)\]", f"{_OPEN}$1{_SHUT}"),
    (rf"\*(?=[^{_OPEN}]*{_SHUT})", _STAR),
    (rf"\?(?=[^{_OPEN}]*{_SHUT})", _MARK),
    (r"([.+^$(){}|\[\]])", r"\\$1"),
    # double stars between slashes, at the start and at the end
    (r"/\*\*(?=/)", f"{_DEEP}"),
    (r"^\*\*/", f"{_ANY}"),
    (r"/\*\*$", f"{_TAIL}"),
    (r"^\*\*$", ".+"),
    # a segment that is one star is not empty; other stars may match nothing
    (rf"(?<![^/{_ANY}])\*(?![^/])", "[^/]+"),
    (r"\*+", "[^/]*"),
    (r"\?", "[^/]"),
    (_DEEP, "(?:/.+)?"),
    (_ANY, "(?:.+/)?"),
    (_TAIL, "/.*"),
    (_OPEN, "["),
    (_SHUT, "]"),
    (_NOT, "^"),
    (_BRACKET, r"\\["),
    (_STAR, r"\\*"),
    (_MARK, r"\\?"),
    (_SLASHED, r"\\\\"),
]


def is_negated(pattern: Column) -> Column:
    return pattern.startswith("!")


def rule_regex(pattern: Column) -> Column:
    """Regex for one pattern (a leading ``!`` is ignored here).

    ``*`` and ``?`` stay inside a segment, ``**`` spans segments, a slash at the
    start or in the middle ties the pattern to the base, one at the end asks for a
    directory.  A match covers everything below a matching directory.
    """
    text = F.regexp_replace(pattern, r"(?<!\\)[ \t]+$", "")
    text = F.regexp_replace(text, r"^!", "")
    folder_only = text.endswith("/")
    body = F.regexp_replace(text, r"/$", "")
    anchored = body.contains("/")
    body = F.regexp_replace(body, r"^/", "")

    deep = body.endswith("/**")
    for regex, replacement in _STEPS:
        body = F.regexp_replace(body, regex, replacement)
    return F.concat(
        F.when(anchored, "^").otherwise("^(?:.+/)?"),
        body,
        F.when(folder_only, "/.*$").when(deep, "$").otherwise("(?:/.*)?$"),
    )


def is_hidden(path: Column) -> Column:
    """True when a parent folder starts with a dot; the file name does not count."""
    return path.rlike(r"(?:^|/)\.[^/]*/")


def with_parents(path: Column) -> Column:
    """The path and each of its parent folders, folders with and without a slash."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    heads = F.transform(
        F.filter(F.sequence(F.lit(0), depth - 1), lambda n: n > 0),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    both = F.flatten(F.transform(heads, lambda h: F.array(h, F.concat(h, F.lit("/")))))
    return F.concat(both, F.array(path))
