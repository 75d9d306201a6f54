"""N-gram Jaccard join: threshold search over inverted lists, after DivideSkip.

A document is the set of its five-word shingles; two link when their sets have
a Jaccard similarity of 0.8 or more. Equal sets are one class from the start.

Sets are compared on a part of the shingles first: those whose hash lies under
a bound that falls with the set's size. Sets of similar size use about the same
part, so of a linked pair at most ``n - overlap`` of the smaller set's part can be
missing from the other: the smaller set must be met in ``T`` of its lists. Lists
with more than ``LIST_SIZE`` members are long. A set with ``L`` long lists merges its
short ones with a heap and keeps what was met ``T - L`` times; the long lists are
not read, and the pair's whole sets are probed instead. This finds all partners
as long as ``L < T``.

For the rest, the sets made of common shingles almost alone, the same search runs over
whole sets, where ``T`` is 8/9 of a set, so that its rarest ninth has to be
merged only. A partner that such a set meets in long lists alone is in ``T`` long lists
of the part that the smaller set asks in, which is no larger than the part that
the partner is listed on; so the partner's long lists are counted on all of its part. These are dealt by size, in blocks of bounded size: each block of
queries meets each block of sets.

Nothing is capped: ``LIST_SIZE`` and block sizes decide by which of the two ways a
link is found. Shingles and sets are told apart by 64-bit hashes.

Edge cases: null and empty texts, and texts without words, have an empty set and
link with nothing, not even each other. Fewer than five words are one shingle.
Repeated rows are one class; documents that share an id stay apart unless they
link. Extra columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import (
    HASH_RUN_BYTES,
    NOT_SPACE,
    mix,
    ranges,
    runs,
    sequence_hashes,
    span_hashes,
    text_bytes,
    word_spans,
)
from .components import connected_components
from .frames import lean, stored

SHINGLE = 5
LIST_SIZE = 32
BLOCK_SHINGLES = 1 << 19
BLOOM_BITS = 23

# Similar sets differ in size by a factor of 1.25 at most, so they are in the
# same or neighbouring classes of size.
_SIZE_STEP = 1.3

_SETS = "doc_id long, n int, cls long, used int, n_long int, all_long int, shingles array<long>"
_LISTS = "cls long, n int, used int, n_long int, all_long int, others array<long>, sizes array<int>"
_FOUND = "x long, y long, n int, n_long int, all_long int, least int"


def overlap_needed(a, b):
    """Common shingles that sets of these sizes need: Jaccard 0.8, rounded up."""
    return (80 * (a + b) + 179) // 180


def _bound(n: np.ndarray) -> np.ndarray:
    """Share of the hash range that sets of size n are first compared on."""
    return np.select([n < 64, n < 256, n < 512, n < 2048], [1.0, 0.5, 0.25, 0.2], 0.16)


def _under(n: np.ndarray) -> np.ndarray:
    """The bound as a signed 64-bit hash; all are less than that of share 1."""
    share = _bound(np.asarray(n))
    high = np.where(share >= 1, 0.0, share) * 2.0**64 - 2.0**63
    return np.where(share >= 1, np.iinfo(np.int64).max, high.astype(np.int64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (signed) of each text of a run."""
    starts, ends, words = word_spans(data, offsets, NOT_SPACE)
    hashes = span_hashes(data, starts, ends)
    several = sequence_hashes(hashes, SHINGLE).view(np.int64)
    for first, last in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        n = last - first
        if n >= SHINGLE:
            yield np.unique(several[first : last - SHINGLE + 1])
        elif n:
            yield sequence_hashes(hashes[first:last], n).view(np.int64) ^ np.int64(n)
        else:
            yield np.zeros(0, np.int64)


def set_class(shingles: np.ndarray) -> int:
    """A hash of the whole set."""
    if not len(shingles):
        return 0
    total = mix(shingles.view(np.uint64)).sum(keepdims=True) + np.uint64(len(shingles))
    return int(mix(total).view(np.int64)[0])


def _sets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(batch.column("text"))
    for first, last in runs(offsets, HASH_RUN_BYTES):
        part = data[offsets[first] : offsets[last]]
        yield from shingle_sets(part, offsets[first : last + 1] - offsets[first])


def _lists(values: Sequence[np.ndarray], kind=np.int64) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if len(values) else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind)))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document; the part of a set to compare only where its class is new to the task.

    A shingle that more than ``LIST_SIZE`` sets of one batch have is long: it is
    counted and not sent. One row without id names such shingles.
    """
    seen: set[int] = set()
    for batch in batches:
        sizes, classes, used, parts = [], [], [], []
        for shingles in _sets_of(batch):
            n, cls = len(shingles), set_class(shingles)
            new = n > 0 and cls not in seen
            seen.add(cls)
            sizes.append(n)
            classes.append(cls)
            parts.append(shingles[: np.searchsorted(shingles, _under(n))] if new else shingles[:0])
            asks = int(np.searchsorted(parts[-1], _under(n + n // 4 + 1)))
            used.append(asks if new else -1)
        values, times = np.unique(np.concatenate([*parts, np.zeros(0, np.int64)]), return_counts=True)
        long = values[times > LIST_SIZE]
        n_long, all_long = np.zeros((2, len(parts)), int)
        if len(long):
            for i, part in enumerate(parts):
                common = np.isin(part, long)
                n_long[i], all_long[i] = common[: max(used[i], 0)].sum(), common.sum()
                parts[i] = part[~common]
        ids = batch.column("doc_id").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*ids, None], pa.int64()),
                pa.array([*sizes, -1], pa.int32()),
                pa.array([*classes, 0], pa.int64()),
                pa.array([*used, 0], pa.int32()),
                pa.array([*n_long, 0], pa.int32()),
                pa.array([*all_long, 0], pa.int32()),
                _lists([*parts, long]),
            ],
            names=["doc_id", "n", "cls", "used", "n_long", "all_long", "shingles"],
        )


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by shingle, size and class: for each set in a list of
    two or more, the part of the list after it, or the mark of a long list.

    At most ``LIST_SIZE`` postings of a list wait for the next batch.
    """
    open_list = np.zeros((3, 0), np.int64)  # the last list, which may go on
    long: int | None = None  # its shingle, if it is long and its postings were passed on
    for batch in batches:
        now = [batch.column(c).to_numpy().astype(np.int64) for c in ("s", "n", "cls")]
        rows = np.concatenate([open_list, np.stack(now)], axis=1)
        if not rows.shape[1]:
            continue
        keep = np.ones(rows.shape[1], bool)
        keep[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        rows = rows[:, keep]
        last = int(np.searchsorted(rows[0], rows[0, -1]))
        if rows.shape[1] - last > LIST_SIZE or rows[0, -1] == long or rows[1, last] < 0:
            yield _suffixes(rows, long)
            open_list, long = rows[:, :0], int(rows[0, -1])
        else:
            if last:
                yield _suffixes(rows[:, :last], long)
            open_list, long = rows[:, last:], None
    if open_list.shape[1]:
        yield _suffixes(open_list, long)


def _suffixes(rows: np.ndarray, long_shingle: int | None) -> pa.RecordBatch:
    shingle, n, cls = rows
    start = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    size = np.diff(np.r_[start, len(shingle)])
    long = (size > LIST_SIZE) | (n[start] < 0)  # too many, or named long by a batch
    if long_shingle is not None:  # went on from the batch before
        long[shingle[start] == long_shingle] = True
    end = np.repeat(start + size, size)
    is_long = np.repeat(long, size)
    at = np.arange(len(shingle))
    # A set asks in the shingles that sets up to 1.25 times its size surely have, too.
    asks = (n >= 0) & (shingle < _under(n + n // 4 + 1))
    rows_out = np.flatnonzero((n >= 0) & is_long | asks & (end - at > 1))
    lengths = np.where(is_long[rows_out], 0, end[rows_out] - rows_out - 1)
    inside = ranges(rows_out + 1, lengths)
    ends = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(cls[rows_out]),
            pa.array(n[rows_out].astype(np.int32)),
            pa.array(np.zeros(len(rows_out), np.int32)),
            pa.array((is_long & asks)[rows_out].astype(np.int32)),
            pa.array(is_long[rows_out].astype(np.int32)),
            pa.ListArray.from_arrays(ends, pa.array(cls[inside])),
            pa.ListArray.from_arrays(ends, pa.array(n[inside].astype(np.int32))),
        ],
        names=["cls", "n", "used", "n_long", "all_long", "others", "sizes"],
    )


def merge_count(lists: Sequence[Sequence[int]], least: int) -> list[tuple[int, int]]:
    """Members met in at least ``least`` of the sorted lists, with their counts (a heap merge)."""
    found = ((member, sum(1 for _ in same)) for member, same in groupby(heapq.merge(*lists)))
    return [(member, count) for member, count in found if count >= least]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by class: candidate pairs, and a row about each set.

    ``least`` is T - L for partners of the same size; under 1 the set is not safe.
    """
    state: dict | None = None
    out: list[tuple] = []

    def finish():
        n, used, n_long = state["n"], state["used"], state["n_long"]
        same_size = used - (n - overlap_needed(n, n))
        out.append((state["cls"], None, n, n_long, state["all_long"], same_size - n_long))
        sizes = state["sizes"]
        for y, met in merge_count(state["lists"], 1):
            m = sizes[y]
            needed = used - (n - overlap_needed(n, m))
            if 100 * n >= 80 * m and met + n_long >= needed:
                out.append((state["cls"], y, n, 0, 0, 0))

    for batch in batches:
        names = ("cls", "n", "used", "n_long", "all_long")
        cls, n, used, n_long, all_long = (batch.column(c).to_numpy() for c in names)
        others, sizes = batch.column("others"), batch.column("sizes")
        at = others.offsets.to_numpy()
        flat, flat_n = others.values.to_numpy(), sizes.values.to_numpy()
        for i in range(batch.num_rows):
            if state is None or state["cls"] != cls[i]:
                if state is not None:
                    finish()
                state = {"cls": int(cls[i]), "n": 0, "used": 0, "n_long": 0, "all_long": 0}
                state |= {"lists": [], "sizes": {}}
            state["n"] = int(n[i])
            state["used"] = max(state["used"], int(used[i]))
            state["n_long"] += int(n_long[i])
            state["all_long"] += int(all_long[i])
            if at[i + 1] > at[i]:
                members = flat[at[i] : at[i + 1]].tolist()
                state["lists"].append(sorted(members))
                state["sizes"].update(zip(members, flat_n[at[i] : at[i + 1]].tolist(), strict=True))
        yield _found_batch(out)
        out.clear()
    if state is not None:
        finish()
        yield _found_batch(out)


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    names = [field.split()[0] for field in _FOUND.split(", ")]
    values = list(zip(*rows, strict=True)) or [()] * 6
    arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _block_links(key, table):
    """Links between a block of queries and a block of sets, by their whole sets.

    A query merges its shortest lists, as many as its partners may lack and one
    more, and probes what was met for the rest. Pairs that links found before
    already connect are not probed.
    """
    table = table.combine_chunks().sort_by([("n", "ascending"), ("cls", "ascending")])
    cls, n = table.column("cls").to_pylist(), table.column("n").to_pylist()
    asks, listed = table.column("asks").to_pylist(), table.column("listed").to_pylist()
    sets = [np.asarray(s) for s in table.column("shingles").to_numpy()]
    inside = [i for i, x in enumerate(listed) if x]
    owner = np.repeat(inside, [len(sets[i]) for i in inside]) if inside else np.zeros(0, int)
    flat = np.concatenate([sets[i] for i in inside]) if inside else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    root = list(range(len(cls)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    known: dict[int, int] = {}
    for i, c in enumerate(cls):  # a set that both asks and is listed is here twice
        root[i] = known.setdefault(c, i)
    links = []
    for x in (i for i, ask in enumerate(asks) if ask):
        own = sets[x]
        first = np.searchsorted(flat, own)
        size = np.searchsorted(flat, own, side="right") - first
        needed = overlap_needed(n[x], n[x])
        shortest = np.argsort(size, kind="stable")[: n[x] - needed + 1]
        lists = [
            [y for y in owner[first[k] : first[k] + size[k]].tolist() if (n[y], cls[y]) > (n[x], cls[x])]
            for k in shortest
            if size[k]
        ]
        for y, _ in merge_count(lists, 1):
            if 100 * n[x] < 80 * n[y] or find(x) == find(y):
                continue
            place = np.searchsorted(sets[y], own)
            place[place == len(sets[y])] = 0
            common = int((sets[y][place] == own).sum())
            if common >= overlap_needed(n[x], n[y]):
                root[find(y)] = find(x)
                links.append((cls[x], cls[y]))
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _bloom(classes: DataFrame) -> bytes:
    """Bits for a table of classes; of fixed size, whatever their number."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bits(batch.column("cls").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], names=["bit"])

    # Eight bits of a byte meet in one row, so at most 2**20 rows come back.
    marked = classes.select("cls").mapInArrow(lean(mark), "bit long")
    rows = (
        marked.groupBy((F.col("bit") / 8).cast("int").alias("byte"))
        .agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("v"))
        .toArrow()
    )
    filled = np.zeros((1 << BLOOM_BITS) // 8, np.uint8)
    filled[rows.column("byte").to_numpy()] = rows.column("v").to_numpy()
    return filled.tobytes()


def _bits(classes: np.ndarray) -> np.ndarray:
    raw, mask = classes.view(np.uint64), np.uint64((1 << BLOOM_BITS) - 1)
    return np.concatenate(
        [((raw >> np.uint64(k)) & mask).astype(np.int64) for k in (0, 20, 40)]
    )


def _whole_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``cls``, ``n`` and all ``shingles`` of the given distinct classes, one row each."""
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little")
        seen: set[int] = set()
        for batch in batches:
            found, kept = [], []
            for shingles in _sets_of(batch):
                cls = set_class(shingles)
                if len(shingles) and cls not in seen and filled[_bits(np.array([cls]))].all():
                    seen.add(cls)
                    found.append(cls)
                    kept.append(shingles)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found, pa.int64()),
                    pa.array([len(s) for s in kept], pa.int32()),
                    _lists(kept),
                ],
                names=["cls", "n", "shingles"],
            )

    sets = docs.select("text").mapInArrow(lean(run), "cls long, n int, shingles array<long>")
    return sets.join(classes, "cls", "left_semi").dropDuplicates(["cls"])


def _size_class(n: str):
    return F.floor(F.log(_SIZE_STEP, F.col(n))).cast("int")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id that links reach)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stored(docs.mapInArrow(lean(_first_pass), _SETS), "jaccard-sets")

    postings = sets.where(F.size("shingles") > 0).select(
        F.explode("shingles").alias("s"), "n", "cls"
    )
    postings = postings.repartition("s").sortWithinPartitions("s", "n", "cls")
    lists = postings.mapInArrow(lean(_inverted), _LISTS)
    about = sets.where("n > 0 and used >= 0").select(
        "cls",
        "n",
        "used",
        "n_long",
        "all_long",
        F.array().cast("array<long>").alias("others"),
        F.array().cast("array<int>").alias("sizes"),
    )
    asked = lists.unionByName(about).repartition("cls").sortWithinPartitions("cls")
    found = stored(asked.mapInArrow(lean(_search), _FOUND), "jaccard-found")

    pairs = found.where("y is not null").select("x", "y")
    about = found.where("y is null").withColumn("size", _size_class("n"))
    unsafe = about.where("least < 1").select("x", "size", "n", "n_long", "least")
    # Per size class (a few dozen rows) the fewest long lists that a partner must be met in.
    fewest = unsafe.groupBy("size").agg(
        F.min(F.col("least") + F.col("n_long")).alias("fewest")
    )
    fewest = fewest.withColumn("asked", F.explode(F.array("size", F.col("size") + 1)))
    common = about.join(
        F.broadcast(fewest.select(F.col("asked").alias("size"), "fewest")), "size"
    ).where("all_long >= fewest")
    whole = common.select(F.col("x").alias("cls"))
    for side in ("x", "y"):
        whole = whole.unionByName(pairs.select(F.col(side).alias("cls")))
    whole = stored(_whole_sets(docs, stored(whole.distinct(), "jaccard-wanted")), "jaccard-whole")

    links = _probe(pairs, whole).unionByName(_search_blocks(unsafe, common, whole))
    roots = connected_components(links)
    classes = sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least_id"))
    classes = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls")
    )
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = classes.join(least, "root").select("cls", "component_id")
    rows = sets.where("n >= 0").select("doc_id", "n", "cls")
    return rows.join(named, "cls", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias(
            "component_id"
        ),
    )


def _probe(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Candidate pairs whose whole sets overlap enough."""
    x = whole.select(F.col("cls").alias("x"), F.col("n").alias("n_x"), F.col("shingles").alias("s_x"))
    y = whole.select(F.col("cls").alias("y"), F.col("n").alias("n_y"), F.col("shingles").alias("s_y"))
    common = F.size(F.array_intersect("s_x", "s_y"))
    needed = F.floor((80 * (F.col("n_x") + F.col("n_y")) + 179) / 180)
    joined = pairs.join(x, "x").join(y, "y").where(common >= needed)
    return joined.select(F.col("x").alias("a"), F.col("y").alias("b"))


def _search_blocks(unsafe: DataFrame, common: DataFrame, whole: DataFrame) -> DataFrame:
    """Links of the sets that have too many long lists, found in blocks of whole sets."""
    asks = unsafe.select(F.col("x").alias("cls"), F.col("size").alias("group"))
    listed = common.select(
        F.col("x").alias("cls"), F.explode(F.array("size", F.col("size") - 1)).alias("group")
    ).distinct()
    listed = listed.join(asks.select("group").distinct(), "group", "left_semi")
    members = asks.withColumn("asks", F.lit(True)).unionByName(
        listed.withColumn("asks", F.lit(False))
    )
    members = members.join(whole, "cls")
    # A row per group of sizes; blocks are numbered by a hash of the class.
    totals = members.groupBy("group").agg(
        *(
            F.ceil(F.sum(F.when(F.col("asks") == flag, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)
            .cast("int")
            .alias(name)
            for flag, name in ((True, "query_blocks"), (False, "set_blocks"))
        )
    )
    dealt = members.join(F.broadcast(totals), "group")
    number = F.xxhash64("cls")
    query = F.when(F.col("asks"), F.array(F.pmod(number, "query_blocks").cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("query_blocks") - 1)
    )
    block = F.when(~F.col("asks"), F.array(F.pmod(number, "set_blocks").cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("set_blocks") - 1)
    )
    dealt = dealt.where("query_blocks > 0 and set_blocks > 0")
    dealt = dealt.withColumn("query", F.explode(query)).withColumn("block", F.explode(block))
    dealt = dealt.select(
        "group", "query", "block", "cls", "n", "asks", (~F.col("asks")).alias("listed"), "shingles"
    )
    return dealt.groupBy("group", "query", "block").applyInArrow(_block_links, "a long, b long")
