import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from flatlake.operators import dedup, filters, geo, history, market, snapshot, stats

DAY = dt.date(2024, 1, 1)


def listings(spark):
    rows = [
        (1, "a", "u1", "flat", "N street", 100, 1, 30.0, 2, "x"), (2, "a", "u2", "flat", "", None, 4, 50.0, None, ""), (3, "b", "u3", "house without furniture", "N street", 300, 5, None, 9, "y"),
        (4, "b", "u4", None, None, 50, None, 20.0, 1, None), (5, "c", "u5", "flat", "M street", None, None, None, None, "z"),
    ]
    return spark.createDataFrame(rows, "id int, source string, url string, title string, address string, price int, rooms int, area double, floor int, description string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("search, keep, drop", [
    (filters.Search(), [1, 2, 3, 4, 5], [1, 2, 3, 4, 5]), (filters.Search(price=(60, 200)), [1, 2, 5], [1]), (filters.Search(rooms=(4,)), [2, 3, 4, 5], [2, 3]),
    (filters.Search(rooms=(1,)), [1, 4, 5], [1]), (filters.Search(query="FLAT"), [1, 2, 5], [1, 2, 5]), (filters.Search(sources=("b",)), [3, 4], [3, 4]),
])
def test_search(spark, search, keep, drop):
    assert ids(filters.search(listings(spark), search, "keep")) == keep
    assert ids(filters.search(listings(spark), search, "drop")) == drop


def test_search_arguments(spark):
    with pytest.raises(ValueError):
        filters.Search(rooms=(9,))
    with pytest.raises(ValueError):
        filters.search(listings(spark), filters.Search(), "maybe")
    assert filters.search(listings(spark), filters.Search(limit=2)).count() == 2
    assert ids(filters.has_substance(listings(spark))) == [1, 2, 3, 4]


def test_point_in_polygon(spark):
    rng = random.Random(1)
    polygon = [(0.0, 0.0), (0.0, 4.0), (2.0, 1.5), (4.0, 4.0), (4.0, 0.0)]
    points = [(rng.uniform(-1, 5), rng.uniform(-1, 5)) for _ in range(300)] + [(None, 1.0)]

    def inside(y, x):
        hit = False
        for (y1, x1), (y2, x2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "id int, lat double, lon double")
    districts = [("line", polygon[:2]), ("first", polygon), ("second", [(0.0, 0.0), (0.0, 5.0), (5.0, 5.0), (5.0, 0.0)])]
    got = {r["id"]: r["d"] for r in df.select("id", geo.district_of(F.col("lat"), F.col("lon"), districts).alias("d")).collect()}
    want = {k: None if y is None else "first" if inside(y, x) else "second" if 0 < y < 5 and 0 < x < 5 else None for k, (y, x) in enumerate(points)}
    assert got == want
    table = spark.createDataFrame([(n, k, [{"lat": y, "lon": x} for y, x in p]) for k, (n, p) in enumerate(districts)], "name string, ord int, polygon array<struct<lat: double, lon: double>>")
    assert {r["id"]: r["district_name"] for r in geo.join_districts(df, table, 0.5).collect()} == want


def test_nearest_station(spark):
    df = spark.createDataFrame([(43.25, 76.9), (None, 76.9)], "lat double, lon double")
    near, none = df.select(geo.nearest_station(F.col("lat"), F.col("lon"), [("b", 43.25, 76.91), ("a", 43.25, 76.91), ("c", 43.0, 76.0)]).alias("s")).collect()
    assert near["s"]["station"] == "a" and 800 < near["s"]["dist"] < 820 and none["s"] is None


def test_fill_from_buildings(spark):
    l = spark.createDataFrame([(1, 7, "", None), (2, 7, "own", 5), (3, None, None, None)], "id int, building_id int, complex string, year int")
    b = spark.createDataFrame([(7, "B", 2000)], "building_id int, complex string, year int")
    got = {r["id"]: (r["complex"], r["year"]) for r in geo.join_buildings(l, b, ["complex", "year"]).collect()}
    assert got == {1: ("B", 2000), 2: ("own", 5), 3: (None, None)}


def test_fingerprint_and_masters(spark):
    rows = [("u1", "Abay 1", 2, 54.8, 3, 250000, DAY, 50), ("u2", "abay 1", 2, 54.0, 3, 258000, DAY - dt.timedelta(1), 40), ("u3", "", None, None, None, None, DAY, 10), ("u4", "", None, None, None, None, None, 10), ("u5", "abay 1", 2, 54.0, 3, 0, None, 98)]
    df = spark.createDataFrame(rows, "url string, loc string, rooms int, area double, floor int, price int, date_published date, quality_score int")
    keyed = df.withColumn("duplicate_group_id", dedup.fingerprint(F.col("loc"), F.col("rooms"), F.col("area"), F.col("floor"), F.col("price")))
    prints = {r["url"]: r["duplicate_group_id"] for r in keyed.collect()}
    assert prints["u1"] == prints["u2"] == "abay 1|2|54|3|240000" and prints["u3"] == "" and prints["u5"].endswith("|_")
    got = {r["url"]: (r["sources_count"], r["quality_score"]) for r in dedup.collapse(keyed).collect()}
    assert got == {"u2": (2, 45), "u3": (1, 10), "u4": (1, 10), "u5": (1, 98)}


def test_first_of_keeps_keyless(spark):
    df = spark.createDataFrame([("a", "u", 2), ("a", "u", 1), ("", None, 3), (None, "", 4)], "source string, url string, n int")
    assert sorted(r["n"] for r in dedup.first_of(df, ["source", "url"], [F.col("n")]).collect()) == [1, 3, 4]
    assert [r["n"] for r in dedup.first_of(df, ["source", "url"], [F.col("n")], keep_keyless=False).collect()] == [1]


def test_clusters(spark):
    rng = random.Random(2)
    rows = [(f"u{k:03}", rng.choice(["", None] + [str(n) for n in range(40)]), rng.choice([""] * 3 + [f"f{n}" for n in range(25)])) for k in range(120)]
    parent = {u: u for u, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, p, f in rows:
        for v, q, g in rows:
            if (p and p == q) or (f and f == g):
                a, b = sorted((find(u), find(v)))
                parent[b] = a
    got = {r["url"]: r["cluster"] for r in dedup.contact_clusters(spark.createDataFrame(rows, "url string, phone string, duplicate_group_id string")).collect()}
    assert got == {u: find(u) for u in parent}


def test_merge(spark):
    kept = spark.createDataFrame([("s", "same", 100, DAY), ("s", "changed", 100, DAY), ("s", "appears", None, DAY), ("s", "unseen", 80, DAY)], "source string, url string, price int, first_seen date")
    seen = spark.createDataFrame([("s", "same", 100), ("s", "changed", 120), ("s", "appears", 120), ("s", "new", 90), ("s", "", 90)], "source string, url string, price int")
    as_of = F.lit(DAY + dt.timedelta(9))
    merged = snapshot.merge(kept, seen, as_of)
    got = {r["url"]: (r["price"], r["first_seen"] == DAY, r["is_new"], r["price_changed"], r["prev_price"], r["seen"]) for r in merged.collect()}
    assert got == {
        "same": (100, True, False, None, None, True), "changed": (120, True, False, True, 100, True), "appears": (120, True, False, None, None, True),
        "new": (90, False, True, None, None, True), "": (90, False, None, None, None, True), "unseen": (80, True, None, None, None, False),
    }
    again = snapshot.merge(merged.select("source", "url", "price", "first_seen"), seen, as_of)
    assert {r["url"]: (r["price"], r["first_seen"]) for r in again.collect()} == {r["url"]: (r["price"], r["first_seen"]) for r in merged.collect()}
    assert [r["url"] for r in snapshot.not_seen(kept, seen).collect()] == ["unseen"]


def test_price_log(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    log = spark.createDataFrame([("a", 100, "K", t[0]), ("a", 150, "K", t[1]), ("b", 90, "K", t[0]), ("b", 80, "K", t[2]), ("c", 5, "K", t[0]), ("d", None, "K", t[0])], "listing_key string, price long, currency string, checked_at timestamp")
    got = {r["listing_key"]: (r["diff"], r["pct"], r["direction"]) for r in history.extremes(log).collect()}
    assert got == {"a": (50, 50.0, "up"), "b": (-10, -11.1, "down"), "c": (0, 0.0, "stable")}
    assert [(r["listing_key"], r["change"]) for r in history.drops(log).collect()] == [("b", -10)]
    now = spark.createDataFrame([("a", 150, "K"), ("b", 81, "K"), ("e", 1, "K"), ("f", None, "K")], "listing_key string, price long, currency string")
    assert sorted(r["listing_key"] for r in snapshot.price_appends(log, now, F.lit(t[4])).collect()) == ["b", "e"]
    asks = spark.createDataFrame([("a", t[0]), ("a", t[3]), ("b", dt.datetime(2023, 1, 1))], "listing_key string, at timestamp")
    assert sorted((r["listing_key"], r["price"]) for r in history.as_of(log, asks).collect() if r["price"]) == [("a", 100), ("a", 150)]
    rates = spark.createDataFrame([("usd", 2.0, t[0]), ("usd", 3.0, t[4])], "currency string, rate double, as_of timestamp")
    assert history.rate_for(rates, "usd", F.lit(t[4]), 9.0).first()["rate"] == 3.0 and history.rate_for(rates, "eur", F.lit(t[4]), 9.0).first()["rate"] == 9.0


@pytest.mark.parametrize("n", [2, 3, 10, 19, 20, 57])
@pytest.mark.parametrize("q", [0.1, 0.3, 0.9])
def test_exclusive_quantile(spark, n, q):
    rng = random.Random(n)
    values = [float(rng.randint(1, 30)) for _ in range(n)]
    got = stats.exclusive_quantile(spark.createDataFrame([("g", v) for v in values], "g string, v double"), ["g"], "v", q).first()["quantile"]
    assert got == pytest.approx(statistics.quantiles(values, n=10)[int(q * 10) - 1])


def test_small_counts(spark):
    df = spark.createDataFrame([("a", "8 707"), ("a", "8707"), ("b", ""), ("b", None)], "source string, phone string")
    assert sorted(r["phone_count"] for r in stats.phone_repeats(df).collect()) == [0, 0, 2, 2]
    e = spark.createDataFrame([(k, dt.datetime(2024, 1, 1, 0, 0, k // 2)) for k in range(30)], "id int, requested_at timestamp")
    assert {r["id"]: r["position"] for r in stats.queue_positions(e).collect()} == {k: k + 1 for k in range(30)}
    files = spark.createDataFrame([(f"p{k}", dt.datetime(2024, 1, 1 + k // 3, k % 3), 10) for k in range(12)], "path string, used_at timestamp, size long")
    assert sorted(r["path"] for r in stats.retained(files, 100).filter("kept").collect()) == sorted(f"p{k}" for k in range(3, 12))
    assert stats.retained(files, 1000).filter("kept").count() == 12


def test_reposts(spark):
    rows = [("f", "u1", DAY, DAY + dt.timedelta(5)), ("f", "u2", DAY + dt.timedelta(50), DAY + dt.timedelta(60)), ("", "u3", DAY, DAY)]
    got = market.reposts(spark.createDataFrame(rows, "fingerprint string, url string, first_seen date, last_seen date"), 20).collect()
    assert [(r["url"], r["prev_url"], r["gap"]) for r in got] == [("u2", "u1", 45)]


def test_near_listings(spark):
    df = spark.createDataFrame([("a", "x", 2, 50.0, 100), ("b", "x", 2, 52.0, 104), ("c", "x", 2, 52.1, 100), ("d", "x", 3, 50.0, 100), ("e", "", 2, 50.0, 100)], "url string, location string, rooms int, area double, price int")
    assert sorted(tuple(r) for r in dedup.near_listings(df).collect()) == [("a", "b"), ("b", "c")]


@pytest.mark.parametrize("held", [0, 4_000_000])
def test_dictionary_of_any_size(spark, held):
    rng = random.Random(held)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    index = [(word(rng.randint(1, 5)).upper(), rng.choice(["x", "y", None]), rng.randint(0, 30)) for _ in range(60)] + [("", "empty", -1), (None, "null", -2), ("ab", "no place", None)]
    texts = [(k, word(rng.randint(0, 12)), "clash") for k in range(150)] + [(150, None, None), (150, "AB" * 2000, "twice"), (150, "AB" * 2000, "twice")]
    df = spark.createDataFrame(texts, "id long, t string, position string")
    got = geo.lookup_names(df, F.col("t"), spark.createDataFrame(index, "fragment string, name string, position int"), held=held)
    assert got.columns == ["id", "t", "position", "name"]
    order = lambda r: (r[2], r[0].lower(), r[1] is not None, r[1] or "")
    known = sorted((r for r in index if r[0] and r[2] is not None), key=order)
    want = [(i, t, next((n for f, n, _ in known if t is not None and f.lower() in t.lower()), None)) for i, t, _ in texts]
    assert sorted((tuple(r[c] for c in ("id", "t", "name")) for r in got.collect()), key=str) == sorted(want, key=str)
    none = geo.lookup_names(df, F.col("t"), spark.createDataFrame([], "fragment string, name string, position int"), held=held)
    assert {r["name"] for r in none.collect()} == {None}


def test_large_dictionary_of_fragments_alike(spark):
    """Fragments that share all their short pieces: a text is joined by what it holds, not by what shares a piece with it."""
    index = spark.range(20_000).selectExpr("concat('Order ', id, ';') AS fragment", "concat('n', id % 7) AS name", "CAST(id * 7919 % 101 AS INT) AS position")
    notes = spark.range(3000).selectExpr("id", "concat('Note: order ', id * 31, '; ORDER ', id * 7, '; order') AS t")
    fragments = index.select(F.lower("fragment").alias("__f"))
    sizes = notes.select(F.size(geo._pieces(fragments, 100_000)(F.lower("t"))).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert sizes[0] <= 2 and sizes[1] <= 6000
    few, all_ = (sorted(tuple(r) for r in geo.lookup_names(notes, F.col("t"), index, held=held).select("id", "name").collect()) for held in (100_000, 4_000_000))
    assert few == all_ and sum(n is not None for _, n in few) > 2000


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_quantiles_of_sets(spark, few):
    """Rows with null keys and values, one group with a third of all rows, and all ties, against sorted lists."""
    from flatlake.operators.skew import quantile_by, quantile_sets

    rng = random.Random(few)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, 5.0, 5.0, float(rng.randint(-9, 99)), rng.random()])) for _ in range(400)] + [("empty", 1, None)] * 3
    df = spark.createDataFrame(rows, "k string, m int, v double").repartition(5)
    sets = [["k", "m"], ["k"], []]
    got = {(r["level"], r["k"], r["m"]): (r["quantile"], r["n"], r["rows"]) for r in quantile_sets(df, sets, "v", 0.3, few=few).collect()}
    want = {}
    for level, own in enumerate(sets):
        for k, m, _ in rows:
            key = level, k if "k" in own else None, m if "m" in own else None
            mine = [v for a, b, v in rows if (a == k or "k" not in own) and (b == m or "m" not in own)]
            values = sorted(v for v in mine if v is not None)
            at = 0.3 * (len(values) - 1)
            low = int(at)
            want[key] = (None if not values else values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low]), len(values), len(mine))
    assert got.keys() == want.keys()
    for key, (q, n, size) in want.items():
        assert got[key][1:] == (n, size) and (got[key][0] is None if q is None else got[key][0] == pytest.approx(q))
    assert {r["k"] for r in quantile_by(df, ["k"], "v", 0.5, few=few).collect()} == {"hot", "a", "b", None}
    assert quantile_sets(df.limit(0), sets, "v", 0.5, few=few).collect() == [] and quantile_by(df.limit(0), [], "v", 0.5, few=few).collect() == []


def test_peer_ratios_keep_all_rows(spark):
    df = spark.createDataFrame([("a", None, 10), ("a", None, 30), (None, 1, 5), ("b", 1, None), ("b", 1, 4)], "source string, rooms int, price int")
    got = market.peer_ratio(df, ["source", "rooms"]).collect()
    assert sorted((str(r["source"]), r["price"] or 0, r["peer_median"], r["ratio"]) for r in got) == [("None", 5, 5.0, 1.0), ("a", 10, 20.0, 0.5), ("a", 30, 20.0, 1.5), ("b", 0, 4.0, None), ("b", 4, 4.0, 1.0)]


def test_portfolio_by_phones(spark):
    rows = [(1, 10, "8 707 123 45 67", 100), (2, None, "+7(707)1234567", 300), (3, 11, None, 5), (4, 12, "7071234567", 7), (5, None, "", 9), (6, None, "x", 9), (7, 99, "8 700 000 00 00", 1)]
    rows += [(100 + k, None, "8 701 000 00 00", 50) for k in range(60)]  # most rows have one number
    df = spark.createDataFrame(rows, "id int, provider_org_id int, phone string, price int").withColumn("name", F.lit("clash"))
    orgs = spark.createDataFrame([(10, "A", ["87071234567", "87071234567", None]), (11, "B", []), (12, "C", None), (13, "D", ["+7 701 000-00-00", "x"]), (14, "E", ["8 701 0000000"]), (None, "N", ["87000000000"])], "org_id int, name string, phones array<string>")
    got = sorted((r["id"], r["org_id"], r["name"]) for r in market.with_organizations(df, orgs).collect())
    assert got == sorted([(1, 10, "A"), (2, 10, "A"), (3, 11, "B"), (4, 10, "A"), (4, 12, "C"), *((100 + k, o, n) for k in range(60) for o, n in ((13, "D"), (14, "E")))])
    assert {r["org_id"] for r in market.with_organizations(df, orgs.drop("phones")).collect()} == {10, 11, 12}


def test_portfolio_of_organizations_with_the_same_numbers(spark, monkeypatch):
    """Their listings are summed up once, not once for each organization; those named by id have more listings."""
    rows = [(k, 3 if k < 4 else None, "8 707 123 45 67" if k % 2 else "8 701 000 00 00", 10 * k, "d", 2, 40.0) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, provider_org_id int, phone string, price int, district string, rooms int, area double")
    orgs = spark.createDataFrame([(k, f"o{k}" if k % 9 else None, ["87071234567", None, "x"][:: 1 if k % 2 else -1]) for k in range(60)] + [(99, "none", [])], "org_id int, name string, phones array<string>")
    sizes, joined = [], market.with_organizations
    monkeypatch.setattr(market, "with_organizations", lambda a, b: sizes.append((out := joined(a, b)).count()) or out)
    got = {(r["org_id"], r["name"], r["n"], r["median_price"]) for r in market.agency_portfolio(df, orgs).collect()}
    assert got == {(k, f"o{k}" if k % 9 else None, *((22, 180.0) if k == 3 else (20, 200.0))) for k in range(60)}
    assert sizes == [42]


@pytest.mark.parametrize("many", [2, 10_000])
def test_near_listings_at_one_place(spark, many):
    """Half of the rows at one location, room count and area: by all pairs, and in narrow cells."""
    rng = random.Random(many)
    rows = [(f"h{k}", "hot", 2, 50.0 + rng.choice([0, 1, 2.0]), rng.randint(1000, 9000)) for k in range(150)] + [(f"x{k}", rng.choice(["a", "b", "hot", ""]), rng.choice([1, 2, None]), float(rng.randint(20, 60)), rng.choice([0, None, 95, 100, 1000, 950, 951])) for k in range(150)]
    rows += [(f"e{k}", "edge", None, 30.0, round(1000 * 0.95**k * 1e6)) for k in range(40)]
    df = spark.createDataFrame(rows, "url string, location string, rooms int, area double, price long")
    got = {tuple(r) for r in dedup.near_listings(df, held=10_000, many=many).collect()}
    good = [r for r in rows if r[1] and r[4] and r[4] > 0]
    want = {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[1:3] == b[1:3] and abs(a[3] - b[3]) <= 2 and abs(a[4] - b[4]) <= 0.05 * max(a[4], b[4])}
    assert got == want


def test_near_listings_pairs_stay(spark):
    """Pairs are shuffled again only where a URL has several rows."""
    rng = random.Random(4)
    rows = [(f"u{k}", rng.choice("xy"), 2, 50.0 + rng.randint(0, 3), rng.randint(90, 110)) for k in range(80)]
    for own in (rows, [(u if k % 3 else "u1", *r) for k, (u, *r) in enumerate(rows)]):
        found = dedup.near_listings(spark.createDataFrame(own, "url string, location string, rooms int, area double, price long"))
        want = {(a[0], b[0]) for a in own for b in own if a[0] < b[0] and a[1:3] == b[1:3] and abs(a[3] - b[3]) <= 2 and abs(a[4] - b[4]) <= 0.05 * max(a[4], b[4])}
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
        assert ("Aggregate [a#" in found._jdf.queryExecution().optimizedPlan().toString()) == (own is not rows)


def test_pinned_leaves_no_shuffle_files(spark):
    """What a kept table was shuffled by doesn't stay on disk; the setting of the session is as before, and the rows can be used again."""
    import time

    from flatlake.operators.skew import CLEANED, pinned

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return sum(found.apply(k).getName().startswith("shuffle_") for k in range(found.size()))

    before, was = files(), spark.conf.get(CLEANED, "false")
    rows = pinned(spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("a.b")).repartition(6, "k"))
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(CLEANED, "false") == was
    assert rows.columns == ["k", "a.b"] and rows.groupBy("k").count().count() == 7 and rows.join(rows.select(F.col("k").alias("j")).distinct(), F.col("k") == F.col("j")).count() == 5000


def test_large_dictionary_in_slices(spark, monkeypatch):
    """The pieces of a part of the texts are shuffled at a time, and all rows get their names: of texts that many rows have, and null ones too."""
    index = spark.range(2000).selectExpr("concat('Order ', id, ';') AS fragment", "concat('n', id % 7) AS name", "CAST(id * 7919 % 101 AS INT) AS position")
    notes = spark.range(900).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'order 5; ORDER 6;' WHEN id % 10 < 9 THEN concat('Note: order ', id * 3, '; ORDER ', id * 2, '; order') END AS t")
    sizes, kept = [], geo.pinned
    monkeypatch.setattr(geo, "pinned", lambda df: sizes.append((out := kept(df)).count()) or out)
    monkeypatch.setattr(geo, "SLICED", 4000)
    few, all_ = (sorted(map(tuple, geo.lookup_names(notes, F.col("t"), index, held=held).select("id", "name").collect())) for held in (1000, 4_000_000))
    assert few == all_ and len(few) == 900 and sum(n is not None for _, n in few) > 700
    assert len(sizes) > 4 and sum(sizes) > 600 and max(sizes) < 250
