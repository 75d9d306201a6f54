"""Jobs from the command line.

    python -m tremorline prepare RAW STAGING [--max-records N] [--last-days N]
    python -m tremorline replay RAW STAGING LANDING [--max-records N] [--pause SECONDS]
    python -m tremorline stream LANDING OUT CHECKPOINT [--changelog] [--every DURATION]
    python -m tremorline compact OUT UP_TO_BATCH
"""

from __future__ import annotations

import argparse

from .plans import deliver_ranges, prepare_microfiles, prepare_replay
from .plans.prepare import RANGE_RECORDS
from .session import ROCKSDB_STATE, open_session
from .sources import MAX_RECORDS, read_raw
from .streaming import build_stream, compact, wait_for_all


def _prepare(spark, args):
    prepare_microfiles(spark, args.raw, args.staging, args.max_records, args.last_days)


def _replay(spark, args):
    raw = read_raw(spark, args.raw)
    prepare_replay(
        raw, args.staging, args.max_records, fixed_order=True, range_records=args.range_records
    )
    deliver_ranges(spark, args.staging, args.landing, pause=args.pause)


def _stream(spark, args):
    queries = build_stream(
        spark,
        args.landing,
        args.out,
        args.checkpoint,
        mode="changelog" if args.changelog else "final",
        every=args.every,
        until_caught_up=args.until_caught_up,
        table="append" if args.append else "versioned",
        partition_by=args.partition_by,
        archive=args.archive,
        max_files=args.max_files,
        max_bytes=args.max_bytes,
        state_partitions=args.state_partitions,
    )
    wait_for_all(queries)


def _compact(spark, args):
    compact(spark, args.out, int(args.up_to_batch), kept_versions=args.kept_versions)


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tremorline")
    jobs = parser.add_subparsers(required=True)

    def job(function, about, *paths):
        added = jobs.add_parser(function.__name__.strip("_"), help=about)
        added.set_defaults(run=function)
        for path in paths:
            added.add_argument(path)
        return added

    prepare = job(_prepare, "cut raw files into feed files", "raw", "staging")
    prepare.add_argument("--max-records", type=int, default=MAX_RECORDS)
    prepare.add_argument("--last-days", type=float, default=0)

    replay = job(_replay, "deliver raw files by range of event time", "raw", "staging", "landing")
    replay.add_argument("--max-records", type=int, default=MAX_RECORDS)
    replay.add_argument("--range-records", type=int, default=RANGE_RECORDS)
    replay.add_argument("--pause", type=float, default=0, help="seconds after each range")

    stream = job(_stream, "count events as they arrive", "landing", "out", "checkpoint")
    stream.add_argument("--changelog", action="store_true", help="keep changes, not closed windows")
    stream.add_argument("--every", help='time between batches, such as "1 minute"')
    stream.add_argument("--until-caught-up", action="store_true")
    stream.add_argument("--append", action="store_true", help="append plainly, not by batch")
    stream.add_argument("--partition-by", nargs="*", default=[], metavar="COLUMN")
    stream.add_argument("--archive", help="folder outside LANDING for files that are done")
    stream.add_argument("--max-files", type=int, help="files of a batch")
    stream.add_argument("--max-bytes", type=int, help="bytes of a batch, if not by files")
    stream.add_argument("--state-partitions", type=int, help="fixed by the first start")
    stream.add_argument("--rocksdb", action="store_true", help="keep the state in RocksDB")

    merge = job(_compact, "merge batches of a changelog table", "out", "up_to_batch")
    merge.add_argument("--kept-versions", type=int, default=2)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _arguments().parse_args(argv)
    spark = open_session(conf=ROCKSDB_STATE if getattr(args, "rocksdb", False) else None)
    try:
        args.run(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
