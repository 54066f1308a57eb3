from __future__ import annotations

import datetime as dt

from patchloom.streaming import profile


def test_repeated_and_late_records_count_once(spark, tmp_path):
    schema = "case_id string, total_lines_changed int, qchecker_findings int, ingested_at timestamp"
    day = dt.datetime(2024, 1, 1)
    batches = [[("a", 4, 1, day), ("b", 2, 0, day)], [("a", 4, 1, day + dt.timedelta(hours=2)), ("c", 9, None, day + dt.timedelta(1)), (None, 1, 1, day), ("d", 1, 1, None)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = (
            profile.profile(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName(f"profile{k}")
            .option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
    got = {(r.day, r.n, r.mean_changed, r.detection_rate) for r in spark.table("profile1").collect()}
    assert got == {(day, 2, 3.0, 0.5), (day + dt.timedelta(1), 1, 9.0, None)}
