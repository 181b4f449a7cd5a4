"""Patterns kept as rows of a table: which texts they can match, by equality on short pieces.

A pattern's longest literal must stand in any text that it matches. The first GRAM characters of it
are the piece by which texts find the pattern; then the pattern itself decides. Thousands of rules
cost a text the few that share a piece with it, and those without a literal.
"""

from __future__ import annotations

import re
from re import _constants as sre_constants
from re import _parser as sre_parse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.functions.text import re2

#: Characters by which texts find the patterns that may match them.
GRAM = 4


def required_pieces(pattern: str) -> list[str]:
    """Pieces of GRAM characters in lower case of which any text that the pattern matches, itself
    in lower case, holds at least one; empty if that cannot be told. Each alternative gives one
    piece, of its longest literal."""
    if re.search(r"\(\?[a-z]*x", pattern):
        return []
    try:
        parsed = list(sre_parse.parse(re.sub(r"\(\?[a-z]+\)", "", pattern)))
    except re.error:
        return []
    while len(parsed) == 1 and parsed[0][0] is sre_constants.SUBPATTERN:
        parsed = list(parsed[0][1][-1])
    branches = [parsed]
    if len(parsed) == 1 and parsed[0][0] is sre_constants.BRANCH:
        branches = [list(b) for b in parsed[0][1][1]]
    found = []
    for branch in branches:
        runs = [""]
        for kind, value in branch:
            if kind is sre_constants.LITERAL and chr(value).isascii():
                runs[-1] += chr(value).lower()
            else:
                # Whatever else stands there, it parts what must be there as it is.
                runs.append("")
        longest = max(runs, key=len)
        if len(longest) < GRAM:
            return []
        found.append(longest[:GRAM])
    return sorted(set(found))


def rule_index(rules: DataFrame) -> DataFrame:
    """The rules (with a column `pattern`, in RE2 spelling) once for each piece by which they are
    found: `piece` is '' for a rule that every text must be tried with; `java_pattern` is what
    Spark evaluates."""
    # Both columns from one function: as functions of their own, filters on them run Python again.
    found = F.udf(
        lambda p: [(re2(p or ""), piece) for piece in required_pieces(p or "") or [""]],
        "array<struct<java_pattern: string, piece: string>>",
    )
    return rules.select("*", F.inline(found("pattern")))


def matching(texts: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """Each row of texts with each rule of a `rule_index` whose pattern matches the column, once."""
    # The one letter that folds to an ASCII one, but not by lower case.
    plain = F.translate(F.lower(column), "ſ", "s")
    # A column of its own: inside the lambda the whole text would be made again for each place.
    places = f"sequence(1, length(_plain) - {GRAM - 1})"
    pieces = f"CASE WHEN length(_plain) >= {GRAM} THEN transform({places}, i -> substring(_plain, i, {GRAM})) ELSE CAST(array() AS array<string>) END"
    asked = texts.withColumn("_plain", plain).withColumn("piece", F.expr(f"explode(array_distinct(concat(array(''), {pieces})))")).drop("_plain")
    # A rule of several alternatives may be met by more than one of them.
    return asked.join(rules, "piece").filter(f"{column} rlike java_pattern").drop("piece", "java_pattern", "pattern").distinct()
