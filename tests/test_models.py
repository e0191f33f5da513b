import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flatlake.ml import labels, model


def brute_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else 0.5


def evaluation(spark, rows):
    return spark.createDataFrame(rows, "good int, prob double")


@pytest.mark.parametrize("rows", [[(1, 0.5), (0, 0.5)], [(1, 0.9), (1, 0.2)], [(k % 3 == 0, round(random.Random(k).random(), 1)) for k in range(80)], [(1, 1.0), (0, 0.0), (0, 1.0)]])
def test_auc(spark, rows):
    assert model.auc(evaluation(spark, [(int(y), p) for y, p in rows])).first()["auc"] == pytest.approx(brute_auc(rows))


def test_thresholds(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(200)]
    got = {round(r["t"], 2): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in model.thresholds(evaluation(spark, rows)).collect()}
    assert len(got) == 91
    for t, counts in got.items():
        hit = [(y, round(p * 100) >= round(t * 100)) for y, p in rows]
        assert counts == (sum(y and h for y, h in hit), sum(not y and h for y, h in hit), sum(y and not h for y, h in hit), sum(not y and not h for y, h in hit)), t
    best = model.best_threshold(evaluation(spark, rows)).first()
    assert best["f1"] == max(2 * a / (2 * a + b + c) if a else 0 for a, b, c, _ in got.values())


def test_labels(spark):
    df = spark.createDataFrame([(p, 2, "d", 40.0) for p in (100000, 110000, 120000, 200000, 300000)] + [(90000, 3, None, None)], "price long, rooms int, district string, area double")
    got = {r["price"]: r["good"] for r in labels.median_label(df).collect()}
    assert [got[p] for p in (100000, 110000, 120000, 200000, 300000)] == [1, 1, 1, 0, 0]
    buckets = spark.createDataFrame([(15.0,), (31.0,), (None,)], "a double").select(labels.area_bucket(F.col("a")).alias("b")).collect()
    assert [r["b"] for r in buckets] == ["0", "2", "?"]
    strict = labels.quantile_label(df, compat="strict").select("good").collect()
    assert all(r["good"] == 0 for r in strict)
    assert labels.quantile_label(df, 0.3, least=3).filter("good = 1").count() >= 1


def test_guard():
    with pytest.raises(ValueError):
        labels.guard(["area", "price_per_m2"])


def test_folds_are_stratified_and_stable(spark):
    df = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("int").alias("good"))
    a = {r["id"]: r["fold"] for r in model.folds(df, 5, ["id"]).collect()}
    assert a == {r["id"]: r["fold"] for r in model.folds(df.repartition(7), 5, ["id"]).collect()}
    for good in (0, 1):
        sizes = [sum(1 for i, f in a.items() if f == k and (i % 4 == 0) == bool(good)) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_train_score_annotate(spark):
    rng = random.Random(4)
    rows = [(k, f"u{k}", float(rng.randint(20, 90)), rng.choice("ab"), None if k % 17 == 0 else rng.randint(1, 4)) for k in range(300)]
    df = spark.createDataFrame([(*r, int(r[2] * 10 + (50 if r[3] == "a" else 0)), int(r[2] < 50)) for r in rows], "id int, url string, area double, source string, rooms int, price long, good int")
    p = model.Preparation.fit(df, ["area", "rooms"], ["source"])
    ready = p.transform(df)
    assert len(ready.first()["features"]) == 4
    fitted = model.boosted(model.folds(ready, 5, ["id"]).filter("fold > 0"), rounds=3)
    assert model.auc(model.scored(fitted, ready).select("good", "prob")).first()["auc"] > 0.95
    both = model.network(ready, (1, 2), rounds=20)
    assert model.auc(model.scored(both, ready).select("good", "prob")).first()["auc"] > 0.9
    out = model.annotate(df.withColumn("price", F.when(F.col("id") > 0, F.col("price"))), fitted, p, 0.5).collect()
    assert len(out) == 300 and {r["verdict"] for r in out if r["price"] is not None} <= {"good", "arguable", "expensive"} and [r["verdict"] for r in out if r["price"] is None] == [None]


def test_experiments(spark):
    df = spark.createDataFrame([(f"u{k}", float(k % 60), int(k % 60 < 20)) for k in range(120)], "url string, area double, good int")
    p = model.Preparation.fit(df, ["area"], [])
    table = model.experiments(df, {"trees": lambda d: (p.transform(d), lambda t: model.boosted(t, rounds=2))}, k=2).collect()
    assert table[0]["name"] == "trees" and table[0]["auc"] > 0.9


def test_feature_rows(spark):
    row = (1, "s", "u", "Студия", "евроремонт, посуточно", 300000, 2, 60.0, 5, 9, ["http://1", "x"], True, "SHORT_TERM", "short_term", None, True)
    df = spark.createDataFrame([row], "id int, source string, url string, title string, description string, price long, rooms int, area double, floor int, total_floors int, photos array<string>, furnished boolean, listing_type string, deal_type string, pets_allowed boolean, children_allowed boolean")
    r = labels.feature_rows(df).first()
    assert (r["price_per_m2"], r["price_per_room"], r["floor_ratio"], r["n_photos"], r["is_last_floor"]) == (5000.0, 150000.0, 0.56, 1, 0)
    assert r["tag_daily"] == 1 and r["tag_fully_furnished"] == 1 and "children_ok" in r["tag_list"] and "studio" in r["tag_list"] and r["row_key"] == "s|u" and r["furniture_grade"] == 2


def test_streams(spark, tmp_path):
    from flatlake.streaming import listings as streams

    t0 = dt.datetime(2024, 1, 1)
    rng = random.Random(5)
    rows = [("s", f"u{rng.randint(0, 5)}", rng.randint(1, 4) * 10, t0 + dt.timedelta(hours=k)) for k in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], "source string, url string, price long, observed_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, url string, price long, observed_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def drain(df, name):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(str(tmp_path / name)).collect()

    got = drain(streams.price_changes(stream), "out")
    last, want = {}, []
    for _, u, p, at in rows:
        if u not in last:
            want.append((u, None, p, "new"))
        elif last[u] != p:
            want.append((u, last[u], p, "changed"))
        last[u] = p
    assert sorted(map(str, want)) == sorted(str((r["url"], r["old_price"], r["new_price"], r["kind"])) for r in got)
    stale = drain(streams.price_changes(stream, "1 minute", stale_ms=6 * 3600_000), "stale")
    assert any(r["kind"] == "stale" for r in stale)
    stream.writeStream.foreachBatch(streams.merge_batches(str(tmp_path / "snap"))).option("checkpointLocation", str(tmp_path / "snap-c")).trigger(availableNow=True).start().awaitTermination()
    assert {r["url"]: r["price"] for r in spark.read.parquet(str(tmp_path / "snap/v=2")).collect()} == last


def test_price_changes_by_groups(spark, tmp_path):
    """The same events, stale keys' too, however many keys a call reads; 4,000 keys take few calls."""
    from flatlake.streaming import listings as streams

    t0 = dt.datetime(2024, 1, 1)
    rng = random.Random(6)
    for k in range(4):
        rows = [("s", f"u{rng.randint(0, 12)}", rng.choice([None, 10, 20]), t0 + dt.timedelta(hours=9 * k + rng.randint(0, 12))) for _ in range(12)]
        rows += [("t", f"u{n}", n, t0) for n in range(4000 if k == 0 else 0)]
        spark.createDataFrame(rows, "source string, url string, price long, observed_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, url string, price long, observed_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    for groups in (3, 100_000):
        out = streams.price_changes(stream, "1 minute", stale_ms=6 * 3600_000, groups=groups).filter("source = 's' OR url < 'u2'")
        out.writeStream.format("parquet").option("path", str(tmp_path / f"o{groups}")).option("checkpointLocation", str(tmp_path / f"c{groups}")).trigger(availableNow=True).start().awaitTermination()
        got.append(sorted(map(str, spark.read.schema(out.schema).parquet(str(tmp_path / f"o{groups}")).collect())))
    assert got[0] == got[1] and {k for k in ("new", "changed", "stale") if any(f"'{k}'" in r for r in got[0])} == {"new", "changed", "stale"}
