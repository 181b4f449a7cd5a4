"""URL verdicts from rules and, where no rule fits, from trust spread over the host link graph.

Trust flows along links from seeds, personalised PageRank; distrust flows against links from seeds
(who links to a blocked host is suspect). Both run in the same Spark iterations over host edges,
which are counted once from the pages; a page's own size never matters, only its host's edges. Mass
that reaches a host without links ends there. Seeds are the hosts of which rules allow, or block,
more than half of the pages, weighted by their pages. A host is blocked if its distrust exceeds its
trust.

Steps go on until one moves less than `enough` of the mass in all. A step moves at most `damping` of
what the one before moved, so that many steps always do: the number is no cap. What is smaller than
`enough` of all trust is not followed further.

Null urls and urls without `://` have an empty host and path and no rule; without a host there is
no score, so they are allowed. Null html has no links. Repeated pages count as often as they occur.
Links to hosts without pages are edges as well.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import forget, written

#: (verdict, host and path)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Rules are compiled into one expression; a longer list belongs in a table.
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINKS = r"(?i)(?:href|src|action)\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last condition that is wrapped around is tried first.
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(a, b, n): links from pages of host a to other hosts b."""
    linked = F.regexp_extract_all(F.col("html"), F.lit(LINKS), F.lit(1))
    # A page that links to a host a hundred times casts one vote.
    found = F.explode(F.array_distinct(F.transform(linked, lambda h: F.translate(h, UPPER, LOWER))))
    return (
        pages.select(F.col("host").alias("a"), found.alias("b"))
        .where("a <> '' and b <> '' and a <> b")
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int | None, enough: float) -> DataFrame:
    """(host, trust, distrust) after `rounds` steps or, if that is None, as soon as a step moves
    less than `enough` in all. `seeds`: host, trust, distrust, each column summing to 1 or 0."""
    forward = edges.join(edges.groupBy("a").agg(F.sum("n").alias("all")), "a").select(
        F.col("a").alias("host"), F.col("b").alias("to"), (F.col("n") / F.col("all")).alias("down"), F.lit(0.0).alias("up")
    )
    backward = edges.join(edges.groupBy("b").agg(F.sum("n").alias("all")), "b").select(
        F.col("b").alias("host"), F.col("a").alias("to"), F.lit(0.0).alias("down"), (F.col("n") / F.col("all")).alias("up")
    )
    steps = written(
        forward.unionByName(backward).groupBy("host", "to").agg(F.sum("down").alias("down"), F.sum("up").alias("up")), "hosts-steps"
    )
    start = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    state = stored = written(seeds, "hosts-state")
    # The first step moves at most 2, each further one at most `damping` times the last.
    sure = math.ceil(math.log(enough / 4) / math.log(damping)) + 1 if rounds is None else rounds
    for _ in range(sure):
        moved = state.join(steps, "host").select(
            F.col("to").alias("host"), (F.col("trust") * F.col("down") * damping).alias("trust"), (F.col("distrust") * F.col("up") * damping).alias("distrust")
        )
        after = moved.unionByName(start).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        before = state.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        after = after.join(before, "host", "left").select(
            "host", "trust", "distrust",
            (F.abs(F.col("trust") - F.coalesce("t", F.lit(0.0))) + F.abs(F.col("distrust") - F.coalesce("d", F.lit(0.0)))).alias("change"),
        )
        after = written(after, "hosts-state")
        change = after.agg(F.coalesce(F.sum("change"), F.lit(0.0))).first()[0]
        forget(stored)
        state, stored = after.drop("change"), after
        if change < enough:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"still {change} moves after {sure} steps")
    return state


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    damping: float = 0.85,
    rounds: int | None = None,
    enough: float = 1e-9,
) -> DataFrame:
    """page_id, host, path, rule, verdict, host_verdict (what the links alone say of the host)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    shares = (
        ruled.where("host <> ''")
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad"))
        .select(
            "host",
            F.when(2 * F.col("good") > F.col("n"), F.col("n")).otherwise(0).cast("double").alias("trust"),
            F.when(2 * F.col("bad") > F.col("n"), F.col("n")).otherwise(0).cast("double").alias("distrust"),
        )
    )
    hosts = written(shares, "hosts")
    totals = hosts.agg(F.sum("trust"), F.sum("distrust")).first()
    part = lambda c, total: (F.col(c) / F.lit(float(total or 1) or 1.0)).alias(c)
    seeds = hosts.select("host", part("trust", totals[0]), part("distrust", totals[1]))
    edges = written(host_edges(parts), "hosts-edges")
    scores = propagate(edges, seeds, damping, rounds, enough)
    verdicts = scores.select(
        F.col("host").alias("_host"), F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow").alias("host_verdict")
    )
    return ruled.join(verdicts, F.col("host") == F.col("_host"), "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("host_verdict", F.lit("allow")).alias("host_verdict"),
    )
