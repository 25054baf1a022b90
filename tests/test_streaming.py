from __future__ import annotations

from spindrift.sources.model import SCHEMAS
from spindrift.streaming.frames import each_frame, running_statistics, scalar_stream, watched_values


def test_new_frames_update_statistics_and_watches(spark, tmp_path):
    path = str(tmp_path / "frames")
    frame = lambda s, values: spark.createDataFrame([(s, "P", k, v) for k, v in enumerate(values)], SCHEMAS["cell_scalar"]).coalesce(1).write.mode("append").parquet(path)
    frame(1, [1.0, 3.0])
    stats = running_statistics(scalar_stream(spark, path)).writeStream.format("memory").queryName("frame_stats").outputMode("complete").start()
    try:
        stats.processAllAvailable()
        assert [(r["step"], r["count"], r["mean"]) for r in spark.table("frame_stats").collect()] == [(1, 2, 2)]
        frame(2, [5.0])
        stats.processAllAvailable()
        assert {r["step"]: r["mean"] for r in spark.table("frame_stats").collect()} == {1: 2, 2: 5}
    finally:
        stats.stop()
    seen = []
    for _ in range(2):
        each_frame(watched_values(scalar_stream(spark, path), "P", 2.0, 4.0), lambda df, k: seen.extend(r["value"] for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert sorted(seen) == [1.0, 5.0]
