"""Order MinHash fingerprints, from built-in functions only.

A text's words (cut after 16 characters) form k-mers of three words, told apart
by how often they occurred before. Their hashes fall in bins; the two smallest
of a bin, in the order in which they stand in the text, are hashed together and make one
component. Texts that share k-mers but not their order differ, so the share of
equal components follows edit distance, not only the sets. A bin with fewer
than two takes the next in hash order.

All of it is computed inside the row. The next document is found without a
global sort in one task: ids are cut in ranges of about equal size, each
range also gets the first document of the next one, and a window per range does
the rest. A text is shuffled once.

Edge cases: null texts are empty; a text without words has a fingerprint of
zeros, which is like others of its kind only. A null id counts as the smallest;
documents with one id go by text; repeated rows stay repeated. A single document
is its own next one. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import count_below, let, steps_for

WORDS = r"\S{1,16}"
KMER = 3
CHOSEN = 2  # k-mers of a component
BIN_BITS = 6
BINS = 1 << BIN_BITS

# Documents of a range, and the most ranges; beyond that they grow. Ids looked at for each cut.
ROWS_PER_RANGE = 2000
MAX_RANGES = 1 << 14
KEYS_PER_RANGE = 256

_PLACE_BITS = 30
_PLACE = (1 << _PLACE_BITS) - 1
_HALF = 1 << (BIN_BITS - 1)
_SMALLEST = -(1 << 63)


def components(text: Column) -> Column:
    """``BINS`` numbers of 32 bits."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    return let(F.transform(words, lambda w: F.xxhash64(w)), _from_words)


def _from_words(hashes: Column) -> Column:
    n = F.size(hashes)
    first = F.slice(hashes, 1, F.greatest(n - (KMER - 1), F.least(n, F.lit(1))))
    kmers = F.transform(
        first, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, KMER)))
    )
    return let(kmers, _from_kmers)


def _at_place(hash_: Column, place: Column) -> Column:
    """The hash's high bits with a place in the low ones."""
    return hash_.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long"))


def _high(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(~_PLACE))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_PLACE)).cast("int")


def _from_kmers(kmers: Column) -> Column:
    by_kmer = F.sort_array(F.transform(kmers, lambda h, i: _at_place(h, i)))

    def numbered(ordered: Column) -> Column:
        return let(
            steps_for(ordered),
            lambda steps: F.transform(
                ordered,
                lambda x, i: let(
                    F.when(
                        (i > 0) & (_high(F.get(ordered, i - 1)) == _high(x)),
                        i - count_below(ordered, steps, _high(x)),
                    ).otherwise(0),
                    lambda seen: _at_place(
                        F.xxhash64(F.get(kmers, _place(x)), seen), _place(x)
                    ),
                ),
            ),
        )

    smallest = let(
        F.sort_array(let(by_kmer, numbered)),
        lambda hashed: F.filter(
            hashed,
            lambda x, i: (i < CHOSEN)
            | (_bin(F.get(hashed, F.greatest(i - CHOSEN, F.lit(0)))) != _bin(x)),
        ),
    )
    return let(smallest, lambda chosen: _tuples(kmers, chosen))


def _bin(packed: Column) -> Column:
    return F.shiftright(packed, 64 - BIN_BITS)


def _tuples(kmers: Column, chosen: Column) -> Column:
    bins = F.array(*(F.lit(b).cast("long") for b in range(-_HALF, _HALF)))

    def one(b: Column, steps: Column) -> Column:
        start = count_below(chosen, steps, b * (1 << (64 - BIN_BITS)))
        return let(
            start,
            lambda s: F.xxhash64(
                F.transform(
                    F.sort_array(
                        F.transform(
                            F.sequence(F.lit(0), F.least(F.size(chosen), F.lit(CHOSEN)) - 1),
                            lambda j: _place(F.get(chosen, (s + j) % F.size(chosen))),
                        )
                    ),
                    lambda p: F.get(kmers, p),
                )
            ).bitwiseAND(F.lit(0xFFFFFFFF)),
        )

    made = let(steps_for(chosen), lambda steps: F.transform(bins, lambda b: one(b, steps)))
    nothing = F.array_repeat(F.lit(0).cast("long"), BINS)
    return F.when(F.size(chosen) > 0, made).otherwise(nothing)


def as_text(parts: Column) -> Column:
    return F.lower(F.array_join(F.transform(parts, lambda p: F.lpad(F.hex(p), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components, 0 to 1."""
    same = F.filter(a, lambda x, i: x == F.get(b, i))
    return F.size(same) / F.lit(float(BINS))


def _range_starts(docs: DataFrame) -> list[int]:
    """First ids of ranges of about equal size; at most ``MAX_RANGES`` numbers.

    Where the ranges are cut is estimated from a share of the ids, which bears on their sizes only;
    their first ids are exact. Both read the ids alone.
    """
    keys = docs.select("key")
    rows = keys.count()
    n = min(MAX_RANGES, -(-rows // ROWS_PER_RANGE))
    if n < 2:
        return [row["key"] for row in keys.agg(F.min("key").alias("key")).collect() if rows]
    shares = ",".join(str(k / n) for k in range(1, n))
    some = keys.where(F.pmod(F.xxhash64("key"), F.lit(max(1, rows // (KEYS_PER_RANGE * n)))) == 0)
    cuts = some.agg(
        F.percentile_approx("key", F.split(F.lit(shares), ",").cast("array<double>"), 10 * n)
    ).first()[0]
    found = _longs(sorted(set(cuts or [])))
    steps = _steps(len(set(cuts or [])))
    firsts = keys.groupBy(count_below(found, steps, F.col("key")).alias("range")).agg(
        F.min("key").alias("key")
    )
    return sorted(row["key"] for row in firsts.collect())


def _longs(numbers: list[int]) -> Column:
    """A constant array, as one literal for the planner."""
    return F.split(F.lit(",".join(map(str, numbers)) or "0"), ",").cast("array<bigint>")


def _steps(size: int) -> Column:
    return F.array(*(F.lit(1 << k) for k in range(size.bit_length() - 1, -1, -1))).cast("array<int>")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``parts`` of documents, and the next one's text and parts."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("doc_id", F.lit(_SMALLEST)).cast("long").alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    starts = _range_starts(docs) or [0]
    bounds, steps = _longs(starts), _steps(len(starts))
    own = (count_below(bounds, steps, F.col("key") + 1) - 1).cast("int")
    own = F.when(F.col("key") == F.lit((1 << 63) - 1), len(starts) - 1).otherwise(own)
    before = (F.col("own") + (len(starts) - 1)) % len(starts)
    places = F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("copy")))
    first = F.get(bounds, F.col("own")) == F.col("key")
    copies = F.array(F.struct(before.alias("range"), F.lit(1).alias("copy")))
    dealt = (
        docs.withColumn("own", own)
        .withColumn("parts", components(F.col("text")))
        .withColumn("place", F.explode(F.when(first, F.concat(places, copies)).otherwise(places)))
        .select("doc_id", "key", "text", "parts", "place.range", "place.copy")
    )
    along = Window.partitionBy("range").orderBy("copy", "key", "text")
    return dealt.select(
        "doc_id",
        "text",
        "parts",
        "copy",
        F.lead("text").over(along).alias("next_text"),
        F.lead("parts").over(along).alias("next_parts"),
    ).where("copy = 0")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    The edited text has its last half replaced by as much of the next document.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return (
        with_next(docs)
        .withColumn("n_chars", F.length("text"))
        .withColumn(
            "edited",
            F.concat(
                F.substr("text", F.lit(1), F.col("n_chars") - half),
                F.substr("next_text", F.lit(1), half),
            ),
        )
        .withColumn("edited_parts", components(F.col("edited")))
        .select(
            "doc_id",
            F.col("n_chars").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            as_text(F.col("parts")).alias("fingerprint"),
            as_text(F.col("edited_parts")).alias("edited_fingerprint"),
            likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
            likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
        )
    )
