"""Text primitives as Column builders.

Every function here is a JVM-side expression. Patterns are written in RE2 spelling and go
through `re2`, because Spark evaluates regular expressions with java.util.regex and the two
dialects differ in a few places that change results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
FIELD_SEPARATOR = r"[\p{IsWhite_Space}]+"
MAX_LONG = 9223372036854775807


def re2(pattern: str) -> str:
    r"""Spell an RE2 pattern so that java.util.regex gives the same matches.

    * `.` must exclude only `\n` (Java also stops at `\r`): flag `(?d)`;
    * `(?i)` must fold non-ASCII letters too: `(?iu)`;
    * `\s` must not include the vertical tab;
    * a bare `[` inside a character class must be escaped.
    """
    out = ["(?d)"]
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            if pair == r"\s":
                out.append(r"\t\n\f\r " if in_class else r"[\t\n\f\r ]")
            else:
                out.append(pair)
            i += 2
            continue
        if in_class and ch == "[":
            out.append(r"\[")
        elif ch == "[":
            in_class = True
            out.append(ch)
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        elif pattern.startswith("(?i)", i):
            out.append("(?iu)")
            i += 4
            continue
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(re2(pattern))


def trim(text: Column) -> Column:
    """Strip Unicode white space at both ends (Spark's `trim` strips only U+0020)."""
    return F.btrim(text, F.lit(WHITESPACE))


def fields(text: Column) -> Column:
    """Split on runs of white space, without empty tokens."""
    return F.filter(F.split(text, FIELD_SEPARATOR), lambda t: t != "")


def contains_any(text: Column, *needles: str) -> Column:
    out = text.contains(needles[0])
    for needle in needles[1:]:
        out = out | text.contains(needle)
    return out


def startswith_any(text: Column, *prefixes: str) -> Column:
    out = text.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        out = out | text.startswith(prefix)
    return out


def sanitize_utf8(text: Column) -> Column:
    """Remove ill-formed bytes; well-formed text, genuine replacement characters included, stays.

    Genuine ones are escaped first, byte by byte, so that only those that stand for ill-formed
    bytes are removed."""
    mark, gone = F.lit("\u0001"), F.lit("\ufffd")
    escaped = F.replace(F.replace(text, mark, F.lit("\u0001a")), gone, F.lit("\u0001b"))
    valid = F.replace(F.make_valid_utf8(escaped), gone, F.lit(""))
    restored = F.replace(F.replace(valid, F.lit("\u0001b"), gone), F.lit("\u0001a"), mark)
    return F.when(F.is_valid_utf8(text), text).otherwise(restored)
