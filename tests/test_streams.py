"""Streams in several batches."""

import datetime
import os

from sahaf.streaming import jobs

SNAPSHOT = "provider long, event_id long, ts timestamp, ok boolean, value double"


def test_last_good_quotes_over_batches(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    at = lambda m: base + datetime.timedelta(minutes=m)
    batches = [
        [(1, 1, at(0), True, 5.0), (1, 2, at(10), False, None), (2, 3, at(1), False, None)],
        [(1, 4, at(15), False, None), (1, 5, at(16), False, None), (2, 6, at(17), True, 7.0)],
        [(1, 7, at(20), True, 6.0), (1, 8, at(34), False, None), (2, 9, at(33), False, None)],
        [(3, 10, at(300), True, 1.0)],  # the watermark passes what was held
        [(1, 11, at(301), False, None), (2, 12, at(40), False, None)],  # the second is hours late
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.parquet(f"file://{tmp_path}/in/b{k}")
        for f in (tmp_path / "in" / f"b{k}").glob("*.parquet"):
            f.rename(tmp_path / f"{k}.parquet")
            mtime = 1_700_000_000 + k
            os.utime(tmp_path / f"{k}.parquet", (mtime, mtime))
    (tmp_path / "files").mkdir()
    for k in range(len(batches)):
        (tmp_path / f"{k}.parquet").rename(tmp_path / "files" / f"{k}.parquet")
    like = spark.createDataFrame([], SNAPSHOT)
    got = {r.event_id: (r.status, r.value) for r in jobs.run_to_parquet(jobs.last_good(jobs.source(spark, f"file://{tmp_path}/files", like, 1)), "append", "quotes").collect()}
    assert got == {
        1: ("live", 5.0), 2: ("last-good", 5.0), 3: ("unavailable", None), 4: ("last-good", 5.0), 5: ("unavailable", None), 6: ("live", 7.0),
        7: ("live", 6.0), 8: ("last-good", 6.0), 9: ("unavailable", None), 10: ("live", 1.0), 11: ("unavailable", None),
    } | ({12: got[12]} if 12 in got else {})
    assert got.get(12, ("unavailable", None)) == ("unavailable", None)
