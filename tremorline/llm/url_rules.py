"""URL verdicts: given rules by host and path, and mined association rules for the rest.

Given rules label the URLs they fit. Spark's FP-growth mines which
combinations of URL tokens go with which label; rules are kept by support,
confidence and lift, and where no shorter rule is as sure. They are matched
through an inverted index from token to rules: a rule fires when all its
tokens were met.

A URL has a token for each segment of its path, by depth, and for each key of its
query, wherever they stand. Rules are mined from those that are frequent, counted
over all labelled rows. Of a URL that has more than ``MOST_TOKENS`` of them, those that tell most
about the label are mined: the sets of tokens grow with the power of their
number. Mined rules are matched against all tokens of a URL.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits
no rule and gets the method's verdict like any other. Of two given rules of one
length the first by text wins. Where no mined rule fires, or nothing was labelled,
the verdict is the more frequent label, ``allow`` if they are equal. Repeated rows
count as often as they occur. Other columns stay, but for those named like a
result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import stored

# Host, path and verdict of the given rules.
GIVEN_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

# Tokens of one URL that rules are mined from.
MOST_TOKENS = 12

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6

# Mined rules are broadcast; support bounds their number, and more than this is refused.
MAX_RULES = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class MinedRule(NamedTuple):
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Lower-case host and path; both empty for null and without ``://``."""
    url = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def given_rule(
    host: Column, path: Column, rules: Sequence[tuple[str, str, str]]
) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(
        rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True
    ):
        fits = (
            (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        ) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


def url_tokens(url: str, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL; digits of its path are told by number, not by value."""

    def token(kind: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(kind + ":"), value))

    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    plain = F.coalesce(F.col(url), F.lit(""))
    found = F.array(
        token("scheme", F.lower(F.regexp_extract(plain, r"^([A-Za-z]+)://", 1))),
        token("top", F.element_at(labels, -1)),
        token("site", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")),
        token("sub", F.when(F.size(labels) > 2, F.element_at(labels, 1)).otherwise("")),
        token("depth", F.least(F.size(parts), F.lit(9)).cast("string")),
        token("end", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)),
        token("mark", F.when(plain.contains("#"), "yes").otherwise("")),
    )
    segments = F.transform(
        parts,
        lambda part, i: F.concat(
            F.lit("path"), (i + 1).cast("string"), F.lit(":"), F.regexp_replace(part, "[0-9]+", "0")
        ),
    )
    query = F.split(F.regexp_extract(plain, r"^[^?#]*\?([^#]*)", 1), "[&;]")
    keys = F.transform(query, lambda pair: token("key", F.regexp_extract(pair, "^[^=]*", 0)))
    return F.array_distinct(F.array_compact(F.concat(found, segments, keys)))


def _telling_sets(labelled: DataFrame, least: int, share: float) -> DataFrame:
    """``items``: each row's frequent tokens, the most telling, and its verdict.

    A token tells the more, the farther its share of ``allow`` is from that of all
    rows, in terms of what chance would make of as many rows.
    """
    rows = labelled.withColumn("row", F.monotonically_increasing_id())
    tokens = rows.select("row", F.explode("tokens").alias("token"), "verdict")
    allowed = F.sum((F.col("verdict") == "allow").cast("long"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"), allowed.alias("allowed"))
    telling = F.abs(F.col("allowed") / F.col("n") - share) * F.sqrt("n")
    counts = counts.where(F.col("n") >= least).select("token", (-telling).alias("minus"))
    ranked = F.sort_array(F.collect_list(F.struct("minus", "token")))
    kept = tokens.join(counts, "token").groupBy("row", "verdict").agg(
        F.slice(ranked, 1, MOST_TOKENS)["token"].alias("tokens")
    )
    return kept.select(
        F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items")
    )


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> list[MinedRule]:
    """Rules from ``tokens`` to ``verdict``, the surest first."""
    total = labelled.groupBy("verdict").count().collect()  # one row per label
    n = sum(row["count"] for row in total)
    if n == 0:
        return []
    share = {row["verdict"]: row["count"] / n for row in total}
    # Rows without a frequent token are left out of the sets, so support is of those left.
    least = max(1, math.ceil(min_support * n))
    sets = stored(_telling_sets(labelled, least, share.get("allow", 0.0)), "url-tokens")
    left = sets.count()
    if not left:
        default = min(share, key=lambda v: (-share[v], v))
        return [MinedRule((), default, share[default], 1.0)]
    from pyspark.ml.fpm import FPGrowth  # with pandas, 40 MB that other drivers can do without

    support = min(1.0, min_support * n / left)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(sets)
    rules = (
        model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("=")))
        .where(F.col("lift") > 1)
        .select("antecedent", "consequent", "confidence", "support")
        .limit(MAX_RULES + 1)
        .collect()
    )
    if len(rules) > MAX_RULES:
        raise ValueError("too many rules: raise min_support")
    found = [
        MinedRule(
            tuple(sorted(r["antecedent"])), r["consequent"][0][1:], r["confidence"], r["support"]
        )
        for r in rules
    ]
    found.sort(key=lambda r: (-r.confidence, len(r.tokens), -r.support, r.tokens, r.verdict))
    kept = _without_longer(found)
    default = min(share, key=lambda v: (-share[v], v))
    return [*kept, MinedRule((), default, share[default], 1.0)]


def _without_longer(rules: list[MinedRule]) -> list[MinedRule]:
    """Leaves out rules that a surer or equally sure rule with fewer tokens covers."""
    index, kept = RuleIndex([]), []
    for rule in rules:
        if not any(index.rules[k].verdict == rule.verdict for k in index.fired(rule.tokens)):
            kept.append(rule)
            index.add(rule)
    return kept


class RuleIndex:
    """From token to the rules that have it, by position in ``rules``."""

    def __init__(self, rules: Sequence[MinedRule]):
        self.rules: list[MinedRule] = []
        self.lists: dict[str, list[int]] = defaultdict(list)
        self.empty: list[int] = []
        for rule in rules:
            self.add(rule)

    def add(self, rule: MinedRule) -> None:
        for token in rule.tokens:
            self.lists[token].append(len(self.rules))
        if not rule.tokens:
            self.empty.append(len(self.rules))
        self.rules.append(rule)

    def fired(self, tokens: Sequence[str]) -> Iterator[int]:
        met: dict[int, int] = defaultdict(int)
        for token in set(tokens):
            for k in self.lists.get(token, ()):
                met[k] += 1
        yield from self.empty
        yield from (k for k, n in met.items() if n == len(self.rules[k].tokens))


def judge_urls(
    pages: DataFrame,
    given: Sequence[tuple[str, str, str]] = GIVEN_RULES,
    url: str = "url",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (or null), ``verdict`` and ``why``.

    ``why`` names the tokens of the mined rule that decided; null for a given rule.
    """
    host, path = host_and_path(url)
    new = ["host", "path", "rule", "verdict", "why"]
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    # The caller's columns in one, so that no name can meet one of those used here.
    split = pages.select(
        F.struct(*kept, F.lit(0).alias("_")).alias("own"),
        host.alias("host"),
        path.alias("path"),
        F.col(url).alias("url"),
    )
    name, verdict = given_rule(F.col("host"), F.col("path"), given)
    split = split.select(
        "own",
        "host",
        "path",
        name.alias("rule"),
        verdict.alias("_given"),
        url_tokens("url", F.col("host"), F.col("path")).alias("_tokens"),
    )
    labelled = split.where(F.col("_given").isNotNull()).select(
        F.col("_tokens").alias("tokens"), F.col("_given").alias("verdict")
    )
    rules = mine_rules(labelled, min_support, min_confidence)
    shared = pages.sparkSession.sparkContext.broadcast(rules or [MinedRule((), "allow", 0.0, 0.0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = RuleIndex(shared.value), {}
        for batch in batches:
            tokens = batch.column("_tokens").to_pylist()
            best = []
            for row in tokens:
                key = tuple(row)
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = index.rules[min(index.fired(key))]
                best.append(known[key])
            names = [c for c in batch.schema.names if c != "_tokens"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [
                    pa.array([r.verdict for r in best], pa.string()),
                    pa.array([" ".join(r.tokens) for r in best], pa.string()),
                ],
                names=[*names, "_mined", "_why"],
            )

    schema = split.drop("_tokens").schema.add("_mined", "string").add("_why", "string")
    judged = split.mapInArrow(run, schema)
    return judged.select(
        *(F.col("own").getField(c).alias(c) for c in pages.columns if c not in new),
        "host",
        "path",
        "rule",
        F.coalesce("_given", "_mined").alias("verdict"),
        F.when(F.col("_given").isNull(), F.col("_why")).alias("why"),
    )
