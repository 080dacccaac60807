"""Streams that keep state for a while, and a table that is upserted by buckets."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from callweave.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def file(spark, folder, k, rows, schema):
    """One Parquet file, so that each is a micro-batch of its own."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    new = max(Path(folder).glob("part-*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    new.rename(new.with_name(f"f{k:03}.parquet"))


def run(df, at):
    """The stream's rows, and its last report."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/rows"), q.recentProgress


VISITS = "key string, hash string, ts timestamp"


def test_pages_are_forgotten_and_streams_go_on(spark, tmp_path):
    day = lambda n: T0 + dt.timedelta(days=n)
    visits = [[("a", "x", day(0)), ("b", "x", day(0))], [("a", "x", day(1)), ("a", "y", day(2))], [("b", "x", day(50))], [("c", "z", day(51))], [("a", "y", day(52))]]
    src, at = tmp_path / "in", str(tmp_path / "out")
    stream = lambda: jobs.changed_pages(jobs.stream_of(spark, str(src), most_files=1), keep_days=10)
    for k, rows in enumerate(visits[:3]):
        file(spark, src, k, rows, VISITS)
    run(stream(), at)
    for k, rows in enumerate(visits[3:], 3):  # a second run goes on with offsets and state
        file(spark, src, k, rows, VISITS)
    got, progress = run(stream(), at)
    # "a" is unchanged on day 1, new again on day 52 as it was forgotten after day 12; so is "b" on day 50
    assert sorted((r.key, r.hash, (r.ts - T0).days) for r in got.collect()) == [("a", "x", 0), ("a", "y", 2), ("a", "y", 52), ("b", "x", 0), ("b", "x", 50), ("c", "z", 51)]
    file(spark, src, 9, [("d", "w", day(500))], VISITS)
    file(spark, src, 10, [("d", "w", day(501))], VISITS)
    _, progress = run(stream(), at)
    alive = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
    assert alive and alive[-1] <= 6  # "d" with its timer; keys before it are gone


def test_throttle_keeps_no_key_for_ever(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    events = [[("u", at(0), "error"), ("u", at(10), "error"), ("v", at(10), "error")], [("u", at(20), "error"), ("v", at(30), "login"), ("v", at(31), "error")], [("w", at(90_000), "error")], [("u", at(90_001), "error")]]
    src = tmp_path / "in"
    for k, rows in enumerate(events):
        file(spark, src, k, rows, "id string, ts timestamp, event_type string")
    got, _ = run(jobs.throttled(jobs.stream_of(spark, str(src), most_files=1), "error", "login", 3, 60), str(tmp_path / "out"))
    assert [(r.id, r.ts) for r in got.collect()] == [("u", at(20))]


def folder_bytes(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_upsert_writes_the_buckets_of_a_batch(spark, tmp_path):
    src, at = tmp_path / "in", str(tmp_path / "out")
    rows = lambda lo, hi, v: [(i, v, f"text {i} {v}" * 20) for i in range(lo, hi)]
    schema = "key long, v long, text string"
    file(spark, src, 0, rows(0, 2000, 1), schema)
    table = lambda: jobs.upsert(jobs.stream_of(spark, str(src), most_files=1), "key", "v", at)
    assert table().count() == 2000
    file(spark, src, 1, rows(7, 8, 2), schema)
    found = table()
    assert found.count() == 2000 and found.where("v = 2").select("key").collect()[0].key == 7
    # one bucket of 64 was written for one row
    assert folder_bytes(f"{at}/data/1") < folder_bytes(f"{at}/data/0") / 16
    # an empty run changes nothing
    assert table().count() == 2000


def test_upsert_survives_a_crash_before_the_manifest(spark, tmp_path):
    src, at = tmp_path / "in", str(tmp_path / "out")
    schema = "key long, v long"
    file(spark, src, 0, [(i, 1) for i in range(50)], schema)
    jobs.upsert(jobs.stream_of(spark, str(src), most_files=1), "key", "v", at)
    file(spark, src, 1, [(3, 2), (60, 2)], schema)
    make, fail = jobs.merge_by_id, [True]

    def breaks(*args):
        out = make(*args)
        if fail[0]:  # rows of the batch are written, its manifest is not
            out.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(jobs.BUCKETS)).cast("int")).write.partitionBy("bucket").mode("overwrite").parquet(f"{at}/data/1")
            raise RuntimeError("lost")
        return out

    jobs.merge_by_id = breaks
    try:
        with pytest.raises(Exception, match="lost"):
            jobs.upsert(jobs.stream_of(spark, str(src), most_files=1), "key", "v", at)
        before = jobs.read_upserted(spark, at, schema)
        assert before.count() == 50 and before.where("v = 2").count() == 0
        fail[0] = False
        after = jobs.upsert(jobs.stream_of(spark, str(src), most_files=1), "key", "v", at)
    finally:
        jobs.merge_by_id = make
    assert after.count() == 51 and sorted(r.key for r in after.where("v = 2").collect()) == [3, 60]
