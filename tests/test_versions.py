"""Versioned snapshots, bad rows, isolated sources and live progress."""

import time

import pytest
from pyspark.sql import functions as F

from flatlake.operators import snapshot
from flatlake.sources import files
from flatlake.sources.versions import Snapshots
from flatlake.streaming import listings as streams

ROW = "id int, price long"


def test_commits(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path / "s"))
    assert kept.current() is None and kept.read(ROW).collect() == []
    one, two = spark.createDataFrame([(1, 10)], ROW), spark.createDataFrame([(1, 20), (2, None)], ROW)
    assert kept.commit(one, 3) == 1 and kept.commit(two, 7) == 2  # batch ids skip
    assert kept.commit(one, 7) == 2 and kept.commit(one, 5) == 2  # repeated after a failure
    assert sorted(tuple(r) for r in kept.read(ROW).collect()) == [(1, 20), (2, None)] and [tuple(r) for r in kept.read(ROW, 1).collect()] == [(1, 10)]
    assert [(r["version"], r["batch_id"], r["rows"]) for r in kept.log().orderBy("version").collect()] == [(1, 3, 1), (2, 7, 2)]
    with pytest.raises(ValueError):
        kept.read(ROW, 9)


def test_killed_write_leaves_the_old_version(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path / "s"))
    kept.commit(spark.createDataFrame([(1, 10)], ROW))
    broken = spark.range(100).select(F.when(F.col("id") == 57, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("int").alias("id"), F.lit(1).cast("long").alias("price"))
    with pytest.raises(Exception, match="lost"):
        kept.commit(broken)
    spark.createDataFrame([(9, 9)], ROW).write.parquet(str(tmp_path / "s/data-of-a-dead-writer"))
    assert [tuple(r) for r in kept.read(ROW).collect()] == [(1, 10)] and kept.commit(spark.createDataFrame([], ROW)) == 2
    assert kept.read(ROW).collect() == []


def test_bad_rows(spark, tmp_path):
    (tmp_path / "lines").write_text('{"id": 1, "price": 5}\n{"id": 2, "price": "x"}\n{"id": 3, "pri\n\n[]\n{"id": 4}\n{"id": 5, "price": null, "more": 1}\nnot json\n')
    rows, bad, counts = files.read_checked(spark, str(tmp_path / "lines"), ROW)
    got = sorted((r["id"] or 0, r["price"]) for r in rows.collect())
    assert got[-3:] == [(1, 5), (4, None), (5, None)]
    lines = {r["line"] for r in bad.collect()}
    assert {'{"id": 2, "price": "x"}', '{"id": 3, "pri', "not json"} <= lines and counts.get["bad"] == len(lines) and counts.get["rows"] == len(got)


def test_sources_fail_alone(spark, tmp_path):
    def breaks():
        raise OSError("no such host")

    late = lambda: spark.range(3).select(F.raise_error(F.lit("in a task")).cast("string").alias("url"))
    sources = {"a": lambda: spark.createDataFrame([(1, "u")], "price int, url string"), "b": breaks, "c": late, "d": lambda: spark.createDataFrame([("v", 2.0)], "url string, area double")}
    rows, report = snapshot.collect_sources(spark, sources, str(tmp_path / "out"))
    assert sorted((r["url"], r["price"], r["area"]) for r in rows.collect()) == [("u", 1, None), ("v", None, 2.0)]
    assert {r["source"]: (r["rows"], r["error"] is None) for r in report.collect()} == {"a": (1, True), "b": (0, False), "c": (0, False), "d": (1, True)}
    nothing, _ = snapshot.collect_sources(spark, {"b": breaks}, str(tmp_path / "none"))
    assert nothing is None


def test_live_progress(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("a", k), ("a", None), ("b", 1)], "source string, price long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = streams.ProgressLog()
    spark.streams.addListener(log)
    try:
        rows = streams.progress(spark.readStream.schema("source string, price long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), sources=("a", "b"))
        query = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        end = time.time() + 30
        while str(query.id) not in log.ended and time.time() < end:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert len({batch for own, batch, _ in log.batches if own == str(query.id)}) == 3
    assert log.totals(str(query.id)) == {"rows": 9, "priced": 6, "rows:a": 6, "priced:a": 3, "rows:b": 3, "priced:b": 3}
