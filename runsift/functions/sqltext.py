"""The text primitives as SQL snippets.

Rules are data: dozens of small predicates over a line. As SQL text a whole projection of rules
is parsed in one call per column, where building it from Column objects takes thousands of calls
from Python into the JVM.
"""

from __future__ import annotations

from runsift.functions.text import MAX_LONG, WHITESPACE, re2


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def has(x: str, *words: str) -> str:
    return any_of(*[f"contains({x}, {lit(w)})" for w in words])


def starts(x: str, *words: str) -> str:
    return any_of(*[f"startswith({x}, {lit(w)})" for w in words])


def ends(x: str, *words: str) -> str:
    return any_of(*[f"endswith({x}, {lit(w)})" for w in words])


def match(x: str, pattern: str, needs: str = "") -> str:
    """Regular-expression test. `needs` is text without which the pattern cannot match: a byte
    search for it spares most lines the regex engine."""
    test = f"({x} RLIKE {lit(re2(pattern))})"
    return f"({has(x, needs)} AND {test})" if needs else test


def extract(x: str, pattern: str, group: int = 1) -> str:
    """Capture group, '' when the pattern does not match."""
    return f"regexp_extract({x}, {lit(re2(pattern))}, {group})"


def group(x: str, pattern: str, index: int = 1, needs: str = "") -> str:
    """Capture group of the first match; null (not '') when the pattern does not match."""
    return f"CASE WHEN {match(x, pattern, needs)} THEN {extract(x, pattern, index)} END"


def group_int(x: str, pattern: str, index: int = 1, needs: str = "") -> str:
    """Capture group made of digits as BIGINT, clamped on overflow; null when no match."""
    value = f"coalesce(try_cast({extract(x, pattern, index)} AS BIGINT), {MAX_LONG}L)"
    return f"CASE WHEN {match(x, pattern, needs)} THEN {value} END"


def leading_int(token: str) -> str:
    """A whole token as BIGINT; 0 when it is not an integer, clamped on overflow."""
    clamp = f"if(startswith({token}, '-'), -{MAX_LONG}L - 1L, {MAX_LONG}L)"
    number = lit(r"^[+-]?[0-9]+\z")
    return (
        f"CASE WHEN {token} RLIKE {number} THEN coalesce(try_cast({token} AS BIGINT), {clamp}) "
        "ELSE 0L END"
    )


def trim(x: str) -> str:
    return f"btrim({x}, {lit(WHITESPACE)})"


def when(condition: str, *parts: str) -> str:
    """Concatenation of the parts where the condition holds, else null."""
    value = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    return f"CASE WHEN {condition} THEN {value} END"


def true_if(condition: str) -> str:
    """True where the condition holds, else null: a setter that never clears."""
    return f"CASE WHEN {condition} THEN true END"


def first_word(x: str, words: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {lit(w)}) THEN {lit(w)}" for w in words) + " END"
