"""DuckDB SQL for each registered query, on the ``events`` view.

The SQL is written against the definitions, with DuckDB's own functions, and
shares nothing with the Spark code.
"""

from __future__ import annotations

_FEED = """
feed AS (
  SELECT
    event_id,
    CAST(event_id AS VARCHAR) AS id,
    CASE
      WHEN event_id % 97 = 0 THEN 'not-a-time'
      WHEN event_id % 89 = 0 THEN NULL
      WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')
      WHEN event_id % 4 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
      ELSE CAST(epoch_us(ts) // 1000 AS VARCHAR)
    END AS time,
    CAST(CAST((user_id * 37) % 180 AS INT) - 90 AS VARCHAR) AS latitude,
    CAST(CAST((user_id * 73) % 360 AS INT) - 180 AS VARCHAR) AS longitude,
    '10' AS depth,
    CASE
      WHEN event_id % 19 = 0 THEN ''
      WHEN event_id % 23 = 0 THEN 'n/a'
      WHEN event_id % 101 = 0 THEN 'NaN'
      ELSE CAST((CAST(floor(value) AS INT) % 75) / 10 - CAST(0.5 AS DOUBLE) AS VARCHAR)
    END AS mag,
    'ml' AS magType,
    CASE
      WHEN event_id % 17 = 0 THEN NULL
      WHEN event_id % 11 = 0 THEN concat('South of ', event_type)
      WHEN event_id % 13 = 0 THEN concat(event_type, ', ')
      ELSE concat('5 km NW of ', event_type, ', sub, R', CAST(user_id % 7 AS VARCHAR))
    END AS place,
    'earthquake' AS type
  FROM events
)"""

_ENRICHED = (
    _FEED
    + """,
parsed AS (
  SELECT
    *,
    CASE
      WHEN regexp_full_match(time, '-?[0-9]+') THEN make_timestamp(CAST(time AS BIGINT) * 1000)
      ELSE try_cast(time AS TIMESTAMP)
    END AS event_ts,
    CASE
      WHEN place LIKE '%,%' AND trim(string_split(place, ',')[-1]) <> ''
        THEN trim(string_split(place, ',')[-1])
      ELSE 'Unknown'
    END AS region,
    CASE WHEN isnan(try_cast(mag AS DOUBLE)) THEN NULL ELSE try_cast(mag AS DOUBLE) END AS mag_d
  FROM feed
),
enriched AS (
  SELECT
    *,
    CASE
      WHEN mag_d IS NULL OR mag_d < 0 THEN 'unknown'
      WHEN mag_d < 2 THEN '[0-2)'
      WHEN mag_d < 4 THEN '[2-4)'
      WHEN mag_d < 6 THEN '[4-6)'
      ELSE '6+'
    END AS magnitude_band
  FROM parsed
)"""
)

_TUMBLING = (
    _ENRICHED
    + """,
placed AS (
  SELECT
    *,
    time_bucket(INTERVAL '15 minutes', event_ts) AS window_start,
    time_bucket(INTERVAL '15 minutes', event_ts) + INTERVAL '15 minutes' AS window_end
  FROM enriched
  WHERE event_ts IS NOT NULL
),
watermark AS (
  SELECT make_timestamp(epoch_us(max(event_ts)) // 1000 * 1000) - INTERVAL '30 minutes' AS mark
  FROM placed
)"""
)

_SLIDING = (
    _ENRICHED
    + """,
placed AS (
  SELECT
    region,
    magnitude_band,
    time_bucket(INTERVAL '10 minutes', event_ts) - k * INTERVAL '10 minutes' AS window_start,
    time_bucket(INTERVAL '10 minutes', event_ts) - k * INTERVAL '10 minutes'
      + INTERVAL '30 minutes' AS window_end
  FROM enriched CROSS JOIN range(3) AS steps(k)
  WHERE event_ts IS NOT NULL
),
watermark AS (
  SELECT make_timestamp(epoch_us(max(event_ts)) // 1000 * 1000) - INTERVAL '30 minutes' AS mark
  FROM enriched
)"""
)

_COUNTS = """
SELECT window_start, window_end, region, magnitude_band, count(*) AS count
FROM placed
GROUP BY window_start, window_end, region, magnitude_band"""

_CLOSED_COUNTS = """
SELECT window_start, window_end, region, magnitude_band, count(*) AS count
FROM placed
WHERE window_end <= (SELECT mark FROM watermark)
GROUP BY window_start, window_end, region, magnitude_band"""


def _top(where: str) -> str:
    return f"""
SELECT window_start, window_end, CAST(rank AS INT) AS rank, region, count
FROM (
  SELECT
    *,
    row_number() OVER (PARTITION BY window_start ORDER BY count DESC, region) AS rank
  FROM (
    SELECT window_start, window_end, region, count(*) AS count
    FROM placed
    {where}
    GROUP BY window_start, window_end, region
  )
)
WHERE rank <= 3"""


_CLOSED_TOP = _top("WHERE window_end <= (SELECT mark FROM watermark)")

# Events whose id ends in 0 arrive after all others. They count only in windows
# that the others' watermark has left open.
_LATE = (
    _TUMBLING
    + """,
arrivals AS (
  SELECT *, event_id % 10 = 0 AS late FROM placed
),
first_mark AS (
  SELECT make_timestamp(epoch_us(max(event_ts)) // 1000 * 1000) - INTERVAL '30 minutes' AS mark
  FROM arrivals WHERE NOT late
),
counted AS (
  SELECT window_start, window_end, region, magnitude_band, late
  FROM arrivals
  WHERE NOT late OR window_end > (SELECT mark FROM first_mark)
)"""
)


def _grid(where: str) -> str:
    return f"""
SELECT
  window_start,
  window_end,
  floor(CAST(latitude AS DOUBLE) / 5) * 5 AS lat_cell,
  floor(CAST(longitude AS DOUBLE) / 5) * 5 AS lon_cell,
  magnitude_band,
  count(*) AS count
FROM placed
{where}
GROUP BY 1, 2, 3, 4, 5"""


_CLOSED_GRID = _grid("WHERE window_end <= (SELECT mark FROM watermark)")

_ROUNDTRIP = """
SELECT id, time, latitude, longitude, depth, nullif(mag, '') AS mag, magType, place, type
FROM feed"""

SQL = {
    "event_time": f"WITH {_ENRICHED} SELECT id, time, event_ts FROM enriched",
    "region_mag": f"WITH {_ENRICHED} SELECT id, region, mag_d, magnitude_band FROM enriched",
    "window_counts": f"WITH {_TUMBLING} {_COUNTS}",
    "sliding_counts": f"WITH {_SLIDING} {_COUNTS}",
    "region_band_counts": f"""WITH {_ENRICHED}
SELECT region, magnitude_band, count(*) AS count FROM enriched GROUP BY region, magnitude_band""",
    "grid_counts": f"""WITH {_FEED}
SELECT
  floor(CAST(latitude AS DOUBLE) / 5) * 5 AS lat_cell,
  floor(CAST(longitude AS DOUBLE) / 5) * 5 AS lon_cell,
  count(*) AS count
FROM feed
GROUP BY 1, 2""",
    "grid_window_counts": f"WITH {_TUMBLING} {_grid('')}",
    "topn_batch": f"WITH {_TUMBLING} {_top('')}",
    "recent_days": f"""WITH {_ENRICHED}
SELECT id, time, place FROM enriched WHERE event_ts >= TIMESTAMP '2024-01-24 00:00:00'""",
    "microfile_roundtrip": f"WITH {_FEED} {_ROUNDTRIP}",
    "replay_roundtrip": f"WITH {_FEED} {_ROUNDTRIP}",
    "stream_final": f"WITH {_TUMBLING} {_CLOSED_COUNTS}",
    "stream_changelog": f"WITH {_TUMBLING} {_COUNTS}",
    "stream_sliding_final": f"WITH {_SLIDING} {_CLOSED_COUNTS}",
    "stream_grid_final": f"WITH {_TUMBLING} {_CLOSED_GRID}",
    "partitioned_readback": f"WITH {_TUMBLING} {_CLOSED_COUNTS}",
    "topn_regions": f"WITH {_TUMBLING} {_CLOSED_TOP}",
    "topn_regions_chained": f"WITH {_TUMBLING} {_CLOSED_TOP}",
    "console_and_table": f"WITH {_TUMBLING} {_CLOSED_COUNTS}",
    "stream_restart": f"WITH {_TUMBLING} {_CLOSED_COUNTS}",
    "stream_late": f"""WITH {_LATE}
SELECT window_start, window_end, region, magnitude_band, count(*) AS count
FROM counted
GROUP BY window_start, window_end, region, magnitude_band""",
    # Batch 0 reads the punctual events, batch 1 reads nothing and lets closed
    # windows go, batch 2 reads the late events. A fourth batch follows only if
    # those moved the watermark.
    "late_batches": f"""WITH {_LATE},
last_mark AS (
  SELECT greatest(
    (SELECT mark FROM first_mark),
    (SELECT mark FROM watermark)
  ) AS mark
),
state AS (
  SELECT window_end, region, magnitude_band, bool_or(NOT late) AS punctual
  FROM counted
  GROUP BY window_end, region, magnitude_band
)
SELECT
  CAST(0 AS BIGINT) AS batch_id,
  (SELECT count(*) FROM feed WHERE event_id % 10 <> 0) AS input_rows,
  TIMESTAMP '1970-01-01 00:00:00' AS watermark,
  false AS late_dropped,
  (SELECT count(*) FROM state WHERE punctual) AS state_rows
UNION ALL
SELECT
  1,
  0,
  (SELECT mark FROM first_mark),
  false,
  (SELECT count(*) FROM state
   WHERE punctual AND window_end > (SELECT mark FROM first_mark))
UNION ALL
SELECT
  2,
  (SELECT count(*) FROM feed WHERE event_id % 10 = 0),
  (SELECT mark FROM first_mark),
  (SELECT count(*) > 0 FROM arrivals
   WHERE late AND window_end <= (SELECT mark FROM first_mark)),
  (SELECT count(*) FROM state WHERE window_end > (SELECT mark FROM first_mark))
UNION ALL
SELECT
  3,
  0,
  (SELECT mark FROM last_mark),
  false,
  (SELECT count(*) FROM state WHERE window_end > (SELECT mark FROM last_mark))
WHERE (SELECT mark FROM last_mark) > (SELECT mark FROM first_mark)""",
}

SQL |= {
    "feed_rejects": """
SELECT
  CAST(event_id AS VARCHAR) AS id,
  concat(event_id, CASE event_id % 10
    WHEN 0 THEN ',1,0,0,0,2,ml,near x, CA,earthquake' ELSE ',1,0' END) AS line
FROM events
WHERE event_id % 10 IN (0, 1)""",
    "replay_order": f"WITH {_FEED} SELECT id, TRUE AS in_order FROM feed",
    "changelog_compacted": SQL["stream_changelog"],
    "append_readback": SQL["stream_final"],
    "window_day_readback": SQL["stream_final"],
    "window_day_pruned": f"""
SELECT * FROM ({SQL["stream_final"]}) AS windows
WHERE window_start >= TIMESTAMP '2024-01-16 00:00:00'""",
    "stream_old_file": SQL["stream_restart"],
    "late_recorded": SQL["late_batches"],
    "late_events": f"""WITH {_LATE}
SELECT id, time, window_start, window_end
FROM arrivals
WHERE late AND window_end <= (SELECT mark FROM first_mark)""",
    "state_reconciled": f"""WITH {_LATE}
SELECT
  window_start,
  window_end,
  region,
  magnitude_band,
  count(*) AS table_count,
  count(*) AS state_count,
  TRUE AS agrees
FROM counted
WHERE window_end > greatest((SELECT mark FROM first_mark), (SELECT mark FROM watermark))
GROUP BY window_start, window_end, region, magnitude_band""",
    "stream_sliding_panes": SQL["stream_sliding_final"],
    "topn_regions_tree": SQL["topn_regions_chained"],
    "event_time_forms": """
SELECT
  CAST(event_id AS VARCHAR) AS id,
  CASE event_id % 8
    WHEN 3 THEN epoch_us(ts) // 1000000 * 1000000
    WHEN 4 THEN -(epoch_us(ts) // 1000 * 1000)
    WHEN 5 THEN epoch_us(ts) // 1000000 * 1000000
    WHEN 6 THEN epoch_us(ts) // 1000 * 1000000
    WHEN 7 THEN 0
    ELSE epoch_us(ts) // 1000 * 1000
  END AS event_us
FROM events""",
}
