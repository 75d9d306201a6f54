"""License scan by ordered signature rules, from built-in functions only.

Most texts have none of the stems that any rule needs, and are only counted.
In the others each rule whose keyword occurs is matched. A match that lies
inside a match of a stronger rule, or inside a longer one of an equally strong
rule, is suppressed; of equal matches the first rule's stays. Everything is
computed inside the row: nothing is shuffled.

Besides the rules there are base phrases, whose every place is counted.

Edge cases: null texts are empty; texts without words have no places, empty
labels and score 0. ASCII capitals are taken as small letters; other capitals
may be too, which no word of a rule or phrase has. Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import count_below, let, steps_for, sums_before
from .license_rules import STEMS, Rule, all_rules

# A word, and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# How sure a match of each priority is; a base phrase alone counts as the weakest.
SURE = {1: 0.99, 2: 0.9, 3: 0.75, 4: 0.5}

_HIT = "struct<start:int,end:int,priority:int,rule:int,label:string>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _in_any(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    found = F.lit(False)
    for group in groups:
        every = F.lit(True)
        for part in group:
            every = every & F.contains(text, F.lit(part))
        found = found | every
    return found


def _strings(values: Sequence[str]) -> Column:
    """A constant array, as one literal for the planner."""
    return F.split(F.lit("\n".join(values)), "\n")


def _hits(joined: Column, rules: Sequence[Rule], number: Column) -> Column:
    """Where a rule matches: character positions in the joined words.

    A match starts and ends at a word's edge.
    """
    pattern = F.get(_strings([f"(?<= )(?:{r.pattern})(?= )" for r in rules]), number)
    label = F.get(_strings([r.label for r in rules]), number)
    priority = F.get(_strings([str(r.priority) for r in rules]), number).cast("int")

    def placed(gaps: Column, found: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return let(
            sums_before(sizes),
            lambda before: F.transform(
                found,
                lambda m, i: let(
                    (F.get(before, i) + F.length(F.get(gaps, i))).cast("int"),
                    lambda start: F.struct(
                        start.alias("start"),
                        (start + F.length(m)).alias("end"),
                        priority.alias("priority"),
                        number.alias("rule"),
                        label.alias("label"),
                    ),
                ),
            ),
        )

    found = F.regexp_extract_all(joined, pattern, F.lit(0))
    return let(
        found,
        lambda m: F.when(
            F.size(m) > 0, let(F.split(joined, pattern, -1), lambda gaps: placed(gaps, m))
        ).otherwise(_none(_HIT)),
    )


def _unsuppressed(hits: Column) -> Column:
    """Hits that lie in no stronger, longer or earlier rule's hit.

    Hits are sorted by start; one that contains another starts before it by no
    more than the longest hit's length, so only those are looked at.
    """

    def inside(d: Column, e: Column) -> Column:
        longer = (e.end - e.start) > (d.end - d.start)
        same = (e.start == d.start) & (e.end == d.end)
        stronger = (e.priority < d.priority) | (
            (e.priority == d.priority) & (longer | (same & (e.rule < d.rule)))
        )
        return (e.start <= d.start) & (e.end >= d.end) & stronger

    def kept(ordered: Column, starts: Column, steps: Column, longest: Column) -> Column:
        def near(d: Column) -> Column:
            first = count_below(starts, steps, (d.start - longest).cast("long"))
            last = count_below(starts, steps, (d.start + 1).cast("long"))
            return F.slice(ordered, first + 1, last - first)

        return F.filter(
            ordered, lambda d: ~F.exists(let(near(d), lambda n: n), lambda e: inside(d, e))
        )

    return let(
        F.array_sort(hits),
        lambda ordered: let(
            F.transform(ordered, lambda h: h.start.cast("long")),
            lambda starts: let(
                steps_for(starts),
                lambda steps: let(
                    F.array_max(F.transform(ordered, lambda h: h.end - h.start)),
                    lambda longest: kept(ordered, starts, steps, longest),
                ),
            ),
        ),
    )


def detections(joined: Column, rules: Sequence[Rule]) -> Column:
    """Unsuppressed hits of the rules in words joined by, and between, spaces."""
    keywords = _strings(sorted({r.keyword for r in rules}))
    of_rule = _strings([r.keyword for r in rules])

    def matched(present: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(len(rules) - 1))
        active = F.filter(numbers, lambda i: F.array_contains(present, F.get(of_rule, i)))
        return F.flatten(F.transform(active, lambda i: _hits(joined, rules, i)))

    present = F.filter(
        keywords, lambda k: F.contains(joined, F.concat(F.lit(" "), k, F.lit(" ")))
    )
    return let(
        present,
        lambda p: F.when(F.size(p) > 0, let(matched(p), _unsuppressed)).otherwise(_none(_HIT)),
    )


def phrase_places(joined: Column, words: Column, phrase: str) -> Column:
    """Numbers of the words at which a phrase starts."""
    parts = phrase.split()

    def at(i: Column) -> Column:
        met = F.lit(True)
        for k, part in enumerate(parts):
            met = met & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return met

    return F.when(
        F.contains(joined, F.lit(f" {phrase} ")),
        F.filter(F.sequence(F.lit(0), F.size(words) - 1), at),
    ).otherwise(_none("int"))


def scan_licenses(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """``docs`` with counts, places, labels, score, and ``hits`` of the rules.

    A hit's ``start`` and ``end`` are character positions in the text's words,
    joined by single spaces and with one before the first. New columns replace
    those of the same name.
    """
    rules = all_rules() if rules is None else rules
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.struct(
        _none("string").alias("words"),
        _none(_HIT).alias("hits"),
        *(_none("int").alias(label) for _, label in PHRASES),
    )

    def scanned(low: Column) -> Column:
        return let(
            F.regexp_extract_all(low, F.lit(WORD), F.lit(0)),
            lambda words: let(
                F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")),
                lambda joined: F.struct(
                    words.alias("words"),
                    detections(joined, rules).alias("hits"),
                    *(phrase_places(joined, words, p).alias(label) for p, label in PHRASES),
                ),
            ),
        )

    gates = [*STEMS, *([tuple(p.split()) for p, _ in PHRASES])]
    found = let(F.lower(text), lambda low: F.when(_in_any(low, gates), scanned(low)).otherwise(none))
    places = F.concat(*(F.col(f"_scan.{label}") for _, label in PHRASES))
    base = F.array_compact(
        F.array(*(F.when(F.size(f"_scan.{x}") > 0, F.lit(x)) for _, x in PHRASES))
    )
    sure = F.create_map(*(F.lit(v) for pair in SURE.items() for v in pair))
    new = {
        "n_words": F.regexp_count(text, F.lit(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))),
        "n_base": F.size(places),
        "first_word": F.array_min(places),
        "last_word": F.array_max(places),
    }
    new = {name: value.cast("long").alias(name) for name, value in new.items()}
    method = F.transform("_scan.hits", lambda h: h.label)
    new["base_labels"] = F.array_join(F.array_sort(base), ",")
    new["labels"] = F.array_join(F.array_sort(F.array_distinct(F.concat(base, method))), ",")
    strongest = F.array_max(F.transform("_scan.hits", lambda h: F.element_at(sure, h.priority)))
    new["score"] = F.greatest(
        F.coalesce(strongest, F.lit(0.0)),
        F.when(F.size(places) > 0, F.lit(SURE[4])).otherwise(F.lit(0.0)),
    )
    new["hits"] = F.col("_scan.hits")
    kept = [c for c in docs.columns if c not in new and c != "_scan"]
    return docs.select(*kept, found.alias("_scan")).select(
        *kept, *(value.alias(name) for name, value in new.items())
    )
