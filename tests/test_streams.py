"""stream_windows against its SQL: events as a folder of files, and odd times."""

import duckdb
import pytest

from gridloom import registry

# around midnights in microseconds, before and after 1970, and without a time
ODD = """
SELECT CAST(1 AS BIGINT) AS event_id, ts, CAST(1 AS BIGINT) AS user_id, event_type, value, '' AS props FROM (
  SELECT make_timestamp(d * 86400000000 + o) AS ts FROM (VALUES (-40000), (-1), (0), (1), (19723)) a(d), (VALUES (-1000000), (-500001), (-500000), (-499999), (-1), (0), (1), (500000)) b(o)
  UNION ALL SELECT CAST(NULL AS TIMESTAMP)), (VALUES ('a', 1.25::DOUBLE), (NULL, 2.5), ('', NULL)) c(event_type, value)
"""


def result(spark, folder, sf_dir, files):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem embeddings".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/{files}'")
    want = c.sql(registry.ORACLES["stream_windows"])
    got = registry.QUERIES["stream_windows"](spark, str(folder)).select(*want.columns)
    return sorted(repr(tuple(r)) for r in got.collect()), sorted(repr(r) for r in want.fetchall())


def test_a_folder_of_event_files_of_several_batches(spark, sf_dir, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    for i in range(30):  # the latest day comes first
        duckdb.sql(f"COPY (SELECT * FROM '{sf_dir}/events.parquet' WHERE day(ts) = {30 - i}) TO '{tmp_path}/events.parquet/part-{i:02d}.parquet' (FORMAT parquet)")
    got, want = result(spark, tmp_path, sf_dir, "events.parquet/*.parquet")
    assert len(want) == 150 and got == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_odd_times(spark, sf_dir, tmp_path, zone):
    duckdb.sql(f"COPY ({ODD}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got, want = result(spark, tmp_path, sf_dir, "events.parquet")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sum(int(r.split(", ")[2]) for r in want) == 123 and got == want


def test_missing_events_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="events.parquet"):
        registry.QUERIES["stream_windows"](spark, str(tmp_path))
