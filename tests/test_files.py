"""Feed files: reading, writing, and the jobs that prepare them."""

from __future__ import annotations

import glob
import os
from datetime import datetime, timezone

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tremorline.functions import event_time
from tremorline.plans import deliver_ranges, prepare, prepare_microfiles, prepare_replay
from tremorline.schema import FEED_COLUMNS, FEED_SCHEMA
from tremorline.sources import (
    feed_columns,
    read_feed,
    read_raw,
    read_rejects,
    read_whole_rows,
    stream_feed,
    write_microfiles,
)
from tremorline.storage import scratch_dir
from tremorline.streaming import read_changelog, start_table, stream_counts

AWKWARD = [
    {"id": "1", "time": "0", "place": "5 km NW of The Geysers, CA", "type": "earthquake"},
    {"id": "2", "place": 'the "old" mine, NV', "mag": "1.0"},
    {"id": "3", "place": " outer spaces, B ", "magType": "ml"},
    {"id": "4", "place": "back\\slash, C"},
    {"id": "5", "place": "Ōita, 日本"},
    {"id": "6"},
]


def _rows(frame):
    return sorted(tuple(row) for row in frame.collect())


def _lines(path):
    return {name: len(open(name).readlines()) - 1 for name in sorted(glob.glob(f"{path}/*.csv"))}


def test_microfiles_keep_values_nulls_and_order(spark, feed, tmp_path):
    frame = feed(*AWKWARD)
    write_microfiles(frame, str(tmp_path / "out"))
    back = read_feed(spark, str(tmp_path / "out"))
    assert back.schema == FEED_SCHEMA
    assert _rows(back.na.fill("-")) == _rows(frame.na.fill("-"))
    header = open(glob.glob(f"{tmp_path}/out/*.csv")[0]).readline().strip()
    assert header == ",".join(FEED_COLUMNS)


def test_microfiles_are_bounded_per_task(spark, tmp_path):
    frame = spark.range(0, 25, 1, 2).select(
        *[F.col("id").cast("string").alias(name) for name in FEED_COLUMNS]
    )
    write_microfiles(frame, str(tmp_path), 10)
    assert sorted(_lines(tmp_path).values()) == [2, 3, 10, 10]
    write_microfiles(frame, str(tmp_path), 100)
    assert sorted(_lines(tmp_path).values()) == [12, 13]
    with pytest.raises(ValueError):
        write_microfiles(frame, str(tmp_path), 0)


def test_empty_fields_are_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(FEED_COLUMNS) + '\n1,,"",,,,,,\n')
    row = read_feed(spark, str(tmp_path)).first()
    assert row["id"] == "1" and row["time"] is None and row["latitude"] is None


def test_raw_columns_are_found_by_name(spark, tmp_path):
    names = ["extra", *reversed(FEED_COLUMNS)]
    (tmp_path / "raw.csv").write_text(
        ",".join(names) + "\n" + ",".join(f'"{n} value"' for n in names) + "\n"
    )
    prepare_microfiles(spark, str(tmp_path / "raw.csv"), str(tmp_path / "out"))
    assert tuple(read_feed(spark, str(tmp_path / "out")).first()) == tuple(
        f"{name} value" for name in FEED_COLUMNS
    )


def test_missing_raw_column_is_an_error(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("id,time\n1,0\n")
    with pytest.raises(AnalysisException):
        feed_columns(read_raw(spark, str(tmp_path / "raw.csv")))


def test_raw_files_with_different_headers_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(FEED_COLUMNS) + "\n" + "a," * 8 + "a\n")
    (tmp_path / "b.csv").write_text(",".join(reversed(FEED_COLUMNS)) + "\n" + "b," * 8 + "b\n")
    with pytest.raises(Exception, match="header"):
        read_raw(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("columns", [["id", "mag"], list(FEED_COLUMNS)])
def test_feed_header_is_checked_on_request(spark, tmp_path, columns):
    (tmp_path / "a.csv").write_text(",".join(reversed(FEED_COLUMNS)) + "\n" + "x," * 8 + "y\n")
    with pytest.raises(Exception, match="header"):
        read_feed(spark, str(tmp_path)).select(*columns).collect()
    by_position = read_feed(spark, str(tmp_path), check_header=False)
    assert by_position.first()["type"] == "y"


def test_prepare_keeps_recent_days_of_both_time_forms(spark, feed, tmp_path):
    now = datetime(2026, 1, 10, tzinfo=timezone.utc)
    frame = feed(
        {"id": "new iso", "time": "2026-01-09T12:00:00Z"},
        {"id": "new millis", "time": str(int(now.timestamp() * 1000) - 1000)},
        {"id": "old", "time": "2025-12-01T00:00:00Z"},
        {"id": "unreadable", "time": "?"},
    )
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    frame.write.option("header", True).csv(raw)
    prepare_microfiles(spark, raw, out, last_days=2, now=now)
    assert {row["id"] for row in read_feed(spark, out).collect()} == {"new iso", "new millis"}
    prepare_microfiles(spark, raw, out)
    assert read_feed(spark, out).count() == 4


def _replayed(spark, path):
    """Rows of the ranges in order, file by file."""
    for folder in sorted(glob.glob(f"{path}/range=*"), key=lambda name: int(name.split("=")[1])):
        for name in sorted(glob.glob(f"{folder}/*.csv")):
            yield folder, read_feed(spark, name).select(
                "id", event_time(F.col("time")).alias("ts")
            ).collect()


@pytest.mark.parametrize("partitions", [None, 5])
def test_replay_ranges_follow_event_time(spark, feed, tmp_path, partitions):
    rows = [{"id": str(i), "time": str((i * 7919) % 1000 * 1000)} for i in range(1000)]
    rows += [{"id": f"none {i}", "time": "?"} for i in range(20)]
    frame = feed(*rows).repartition(6)
    count = prepare_replay(frame, str(tmp_path), 100, partitions, range_records=300)
    replayed = list(_replayed(spark, tmp_path))
    assert len({folder for folder, _ in replayed}) == count == (partitions or 4)
    assert max(len(rows) for _, rows in replayed) <= 100
    flat = [row for _, file_rows in replayed for row in file_rows]
    assert sorted(row["id"] for row in flat) == sorted(row["id"] for row in rows)
    times = [row["ts"] for row in flat]
    known = [t for t in times if t is not None]
    assert times[:20] == [None] * 20 and known == sorted(known)


def test_ranges_are_delivered_in_order(spark, feed, tmp_path, monkeypatch):
    """One call a range; one that ended early is finished; file times do not matter."""
    rows = feed(*[{"id": str(i), "time": str(i * 1000)} for i in range(100)])
    prepared, landing = str(tmp_path / "prepared"), str(tmp_path / "landing")
    assert prepare_replay(rows, prepared, 5, 4) == 4
    real, calls = prepare.rename, []

    def third_fails(spark, old, new):
        calls.append(new)
        if len(calls) == 3:
            raise OSError
        real(spark, old, new)

    monkeypatch.setattr(prepare, "rename", third_fails)
    with pytest.raises(OSError):
        deliver_ranges(spark, prepared, landing)
    assert sorted(os.listdir(landing)) == ["000000000", "000000001"]
    assert deliver_ranges(spark, prepared, landing) == 2 and len(calls) == 5
    assert sorted(os.listdir(landing)) == [f"{i:09d}" for i in range(4)]
    last = -1
    for i in range(4):
        ids = [int(r.id) for r in read_feed(spark, f"{landing}/{i:09d}").collect()]
        assert min(ids) == last + 1
        last = max(ids)
    assert last == 99
    assert deliver_ranges(spark, prepared, landing) == 0


def test_a_large_feed_makes_few_ranges(spark, feed, tmp_path, monkeypatch):
    """Ranges grow to the largest size before there are more of them; all rows stay, in order."""
    monkeypatch.setattr(prepare, "RANGE_RECORDS", 20)
    rows = feed(*[{"id": str(i), "time": str(i * 1000)} for i in range(100)])
    made = []
    for few in (None, 50, 8, 3):
        out = str(tmp_path / f"few-{few}")
        made.append(prepare_replay(rows, out, 5, range_records=5, few_ranges=few))
        last = -1
        for i in range(made[-1]):
            ids = [int(r.id) for r in read_feed(spark, f"{out}/range={i}").collect()]
            assert min(ids) == last + 1 and max(ids) - last == len(ids)
            last = max(ids)
        assert last == 99
    assert made == [20, 20, 8, 5]  # ranges of 5, 5, 13 and 20 rows


class _Taking:
    """Stands for a query: what lies in the landing folder each time it is waited for."""

    def __init__(self, landing: str, fails_at: int = -1):
        self.landing, self.fails_at, self.seen = landing, fails_at, []

    def processAllAvailable(self) -> None:
        self.seen.append(sorted(os.listdir(self.landing)))
        if len(self.seen) == self.fails_at:
            raise OSError


def test_taken_ranges_leave_the_landing_folder(spark, feed, tmp_path):
    """A stream lists one range a batch, however many there are; one that ended early goes on."""
    rows = feed(*[{"id": str(i), "time": str(i * 1000)} for i in range(100)])
    prepared, landing, taken = (str(tmp_path / name) for name in ("prepared", "landing", "taken"))
    assert prepare_replay(rows, prepared, 5, 4) == 4
    query = _Taking(landing, fails_at=2)
    with pytest.raises(OSError):
        deliver_ranges(spark, prepared, landing, [query], archive=taken)
    assert deliver_ranges(spark, prepared, landing, [query], archive=taken) == 2
    assert query.seen == [[f"{i:09d}"] for i in (0, 1, 1, 2, 3)]
    assert os.listdir(landing) == [] and sorted(os.listdir(taken)) == [f"{i:09d}" for i in range(4)]
    assert sorted(int(r.id) for r in read_feed(spark, f"{taken}/*").collect()) == list(range(100))
    assert deliver_ranges(spark, prepared, landing, [query], archive=taken) == 0
    with pytest.raises(ValueError, match="needs queries"):
        deliver_ranges(spark, prepared, landing, archive=taken)


def test_a_stream_goes_on_after_its_ranges_were_taken_away(spark, feed, tmp_path):
    base = str(tmp_path)
    for part in range(2):
        hours = range(part * 10, part * 10 + 10)
        rows = feed(*[{"id": str(i), "time": str(i * 3_600_000), "mag": "1"} for i in hours])
        prepare_replay(rows, f"{base}/prepared-{part}", partitions=2)
        query = start_table(
            stream_counts(spark, f"{base}/all/*"), f"{base}/out", f"{base}/cp", mode="changelog"
        )
        try:
            deliver_ranges(
                spark, f"{base}/prepared-{part}", f"{base}/all", [query], archive=f"{base}/t{part}"
            )
        finally:
            query.stop()
    assert os.listdir(f"{base}/all") == []
    assert sum(r["count"] for r in read_changelog(spark, f"{base}/out").collect()) == 20


def test_ranges_are_delivered_when_all_are_prepared(spark, tmp_path):
    with pytest.raises(ValueError, match="list of ranges"):
        deliver_ranges(spark, str(tmp_path), str(tmp_path / "landing"))


@pytest.mark.parametrize("hot", ["1774744598134", None])
def test_replay_cuts_through_a_hot_time(spark, tmp_path, hot):
    """Most rows share a time, or have none; no range gets more than its part."""
    text = F.when(F.col("id") % 10 > 0, F.lit(hot)).otherwise((F.col("id") * 1000).cast("string"))
    frame = spark.range(0, 20_000, 1, 4).select(
        *[
            (text if name == "time" else F.col("id").cast("string")).alias(name)
            for name in FEED_COLUMNS
        ]
    )
    prepare_replay(frame, str(tmp_path), 1_000_000, partitions=8)
    sizes = [sum(_lines(tmp_path / f"range={i}").values()) for i in range(8)]
    assert sum(sizes) == 20_000
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


def test_replay_stores_a_feed_without_fixed_order_first(spark, feed, tmp_path, monkeypatch):
    """Row numbers of other feeds could change when a task is repeated."""
    stored = []

    def recorded(session, label):
        stored.append(label)
        return scratch_dir(session, label)

    monkeypatch.setattr(prepare, "scratch_dir", recorded)
    rows = feed(*[{"id": str(i), "time": "0"} for i in range(50)])
    write_microfiles(rows, str(tmp_path / "in"))
    read = read_feed(spark, str(tmp_path / "in"))
    prepare_replay(read, str(tmp_path / "a"), fixed_order=True)
    assert not stored
    prepare_replay(read.repartition(3), str(tmp_path / "b"))
    assert stored == ["feed"]
    assert _rows(read_feed(spark, str(tmp_path / "b")).select("id")) == _rows(read.select("id"))


def test_replay_of_nothing(spark, feed, tmp_path):
    nothing = feed({"id": "1"}).where("id = '2'")
    assert prepare_replay(nothing, str(tmp_path)) == 0
    assert deliver_ranges(spark, str(tmp_path), str(tmp_path / "landing")) == 0


def test_scratch_without_a_shared_folder_is_local_only(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session, "x")


def test_scratch_lies_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    one, two = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert one != two
    assert all(path.startswith(shared) and os.path.isdir(path) for path in (one, two))


def test_standard_quoting_and_line_breaks(spark, tmp_path, feed):
    """Doubled quotes, commas and backslashes come back; a line break becomes a space."""
    path = tmp_path / "in"
    path.mkdir()
    header = "id,time,latitude,longitude,depth,mag,magType,place,type\n"
    (path / "a.csv").write_text(header + '1,0,1,2,3,4,ml,"5 km of ""X"", CA",quake\n')
    (row,) = read_feed(spark, str(path)).collect()
    assert (row["place"], row["type"]) == ('5 km of "X", CA', "quake")
    places = ['say "a", b', "back\\slash, c", 'end\\"', "line1\nline2, CA", "x\r\ny"]
    rows = [{"id": str(i), "place": place} for i, place in enumerate(places)]
    write_microfiles(feed(*rows), str(tmp_path / "out"))
    found = {r["id"]: r["place"] for r in read_feed(spark, str(tmp_path / "out")).collect()}
    expected = [*places[:3], "line1 line2, CA", "x y"]
    assert found == {str(i): place for i, place in enumerate(expected)}


def test_lines_with_other_numbers_of_values(spark, tmp_path):
    """They are told apart, as a table and as a stream; quoted commas are no separators."""
    whole = ['1,0,0,0,0,1,ml,"near x, CA",earthquake', "2,,,,,,,,"]
    ragged = ["3,0,0,0,0,1,ml,x, CA,earthquake", "4,0,0"]
    (tmp_path / "in").mkdir()
    lines = [",".join(FEED_COLUMNS), whole[0], ragged[0], ragged[1], whole[1]]
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "in")
    rejects = read_rejects(spark, path)
    assert sorted((r.id, r.line) for r in rejects.collect()) == [("3", ragged[0]), ("4", ragged[1])]
    assert rejects.count() == 2
    table = read_whole_rows(spark, path)
    assert table.columns == list(FEED_COLUMNS)
    assert sorted(r.id for r in table.collect()) == ["1", "2"]
    assert table.count() == 2 and {r.place for r in table.select("place").collect()} == {"near x, CA", None}
    query = (
        stream_feed(spark, path, whole_rows=True)
        .writeStream.format("memory").queryName("whole_rows").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    )
    query.awaitTermination()
    assert sorted(r.id for r in spark.table("whole_rows").collect()) == ["1", "2"]
    (tmp_path / "in" / "b.csv").write_text("id,other\n1,2\n")
    with pytest.raises(Exception, match="header"):
        read_whole_rows(spark, path).collect()
