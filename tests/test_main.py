"""The jobs from the command line, in a process of their own."""

from __future__ import annotations

import os
import subprocess
import sys

from tremorline.schema import FEED_COLUMNS
from tremorline.sources import read_feed
from tremorline.streaming import read_changelog

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _job(*arguments) -> str:
    done = subprocess.run(
        [sys.executable, "-m", "tremorline", *map(str, arguments)],
        cwd=REPO,
        env={**os.environ, "PYSPARK_SUBMIT_ARGS": "--conf spark.ui.enabled=false pyspark-shell"},
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_prepare_replay_and_stream(spark, tmp_path):
    lines = [f'{i},{i * 60_000},0,0,1,5,ml,"near x, A",earthquake,more' for i in range(60)]
    raw = tmp_path / "raw.csv"
    raw.write_text(",".join([*FEED_COLUMNS, "more"]) + "\n" + "\n".join(lines) + "\n")
    _job("prepare", raw, tmp_path / "staging", "--max-records", 25)
    assert read_feed(spark, str(tmp_path / "staging")).count() == 60
    assert len(list((tmp_path / "staging").glob("*.csv"))) == 3
    landing = tmp_path / "landing"
    _job("replay", raw, tmp_path / "ranges", landing, "--max-records", 25, "--range-records", 30)
    assert [p.name for p in sorted(landing.iterdir())] == ["000000000", "000000001"]
    printed = _job(
        "stream",
        landing / "*",
        tmp_path / "out",
        tmp_path / "checkpoint",
        "--changelog",
        "--until-caught-up",
        "--max-files",
        "1",
        "--partition-by",
        "region",
        "--archive",
        tmp_path / "archive",
    )
    assert "Batch 0: " in printed
    for _ in range(2):
        counts = read_changelog(spark, str(tmp_path / "out")).collect()
        assert [row["count"] for row in counts] == [15] * 4
        assert list((tmp_path / "out").glob("batch_id=*/region=A"))
        _job("compact", tmp_path / "out", "1", "--kept-versions", "1")
    assert not list((tmp_path / "out").glob("batch_id=[01]"))
