import datetime as dt
import random
import json

import pytest
from pyspark.sql import functions as F

from flatlake.sources import files, pages

SITE = pages.Site(
    "s1", "https://s1.test", r"(?s)<article>(.*?)</article>",
    {"url": r"<a href=\"([^\"]+)\"", "title": r"(?s)<h2>(.*?)</h2>", "price": r"<b class=\"p\">([^<]*)</b>", "address": r"<i>([^<]*)</i>"}, markers="аренда", gone="объявление снято",
)
PAGE = """<html><title>Аренда квартир</title><body>
<article><a href="/a/1"><h2>2-комн. квартира</h2></a><b class="p">250 000 T</b><i>Abay 1</i><img src="/i/p1-120x90.jpg"><img src="/i/sprite.png"> 60 м², 5/9</article>
<article><a href="https://s1.test/a/2"><h2>Студия</h2></a><b class="p"></b></article><article><p>no title</p></article></body></html>"""


def test_cards(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "u", PAGE.replace("Аренда", "Работа")), (3, "u", None)], "page_id int, url string, html string")
    got = {r["url"]: r for r in pages.cards(df, SITE).collect()}
    assert set(got) == {"https://s1.test/a/1", "https://s1.test/a/2"}
    r = got["https://s1.test/a/1"]
    assert (r["price"], r["rooms"], r["area"], r["floor"], r["total_floors"], r["address"]) == (250000, 2, 60.0, 5, 9, "Abay 1")
    assert r["photos"] == ["https://s1.test/i/p1-full.jpg"] and got["https://s1.test/a/2"]["rooms"] == 0


def test_state(spark):
    state = {"lists": {"rents": [{"url": "/r/1", "price": "200 000", "rooms": 2, "area": 45.5, "address": "X {1}"}, {"url": "/r/2", "type": "studio", "price": 9}]}}
    html = f"<script>window.data = {json.dumps(state)}; other({{}})</script>"
    df = spark.createDataFrame([(1, html), (2, "none"), (3, None)], "page_id int, html string")
    got = pages.state_listings(df, pages.embedded_state("window.data")(F.col("html")), "e", ("lists.rents",)).collect()
    assert [(r["price"], r["rooms"], r["area"]) for r in got] == [(200000, 2, 45.5), (9, 0, None)]
    quoted = "x = JSON.parse('{\"lists\":{\"rents\":[{\"url\":\"/q\",\"price\":7}]}}')"
    got = pages.state_listings(spark.createDataFrame([(1, quoted)], "page_id int, html string"), pages.unquoted_state(F.col("html")), "e", ("lists.rents",)).collect()
    assert [(r["url"], r["price"]) for r in got] == [("/q", 7)]


def test_realty(spark):
    items = [
        {"id": "1", "title": "2-комнатная квартира", "ads": [{"price": {"value": 300000}}], "geometry": {"centroid": {"lat": 43.2, "lon": 76.9}}, "floors_total": "9"},
        {"id": "2", "title": "Сниму квартиру"}, {"id": "3", "title": "квартира", "rental_period": "daily"}, {"id": "4", "title": "комната", "description": "за 80 000 тг"},
    ]
    df = spark.createDataFrame([(1, json.dumps({"result": {"items": items}}))], "page_id int, html string")
    got = {r["source_listing_id"]: r for r in pages.realty_json(df).collect()}
    assert set(got) == {"1", "4"} and got["1"]["price"] == 300000 and got["1"]["rooms"] == 2 and got["1"]["lat"] == 43.2 and got["4"]["price"] == 80000


def test_messages(spark):
    m = '<div class="m message_wrap x"><div data-post="c/1"></div><div class="message_text">Сдам квартиру<br/>200 000 тг</div><i style="background-image:url(\'https://p/1.jpg\')"></i><span class="message_views">1.2K</span><time datetime="2024-01-02T03:04:05"></time><!--/message-->'
    df = spark.createDataFrame([(1, m + m.replace("Сдам", "Сниму"))], "page_id int, html string")
    (r,) = pages.messages(df).collect()
    assert (r["post"], r["text"], r["views"], r["photos"]) == ("c/1", "Сдам квартиру\n200 000 тг", 1200, ["https://p/1.jpg"])


def test_details(spark):
    rows = [
        (1, "https://s/a/1/?x=1", '<script type="application/ld+json">{"offers":{"price":"250000"}}</script>{"lat": "43.25", "lon": 76.9}'), (2, "https://s/a/2", '<div data-price="90 000"></div>'),
        (3, "https://s/a/3", "архив"), (4, "u", None),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["page_id"]: (r["price"], r["lat"], r["lon"]) for r in pages.detail_fields(df).collect()}
    assert got == {1: (250000, 43.25, 76.9), 2: (90000, None, None), 3: (None, None, None), 4: (None, None, None)}
    cards = spark.createDataFrame([("https://s/a/3/#x", 77)], "url string, price int")
    assert {r["page_id"]: r["price"] for r in pages.match_cards(pages.detail_fields(df), cards).collect()}[3] == 77
    assert [r["x"] for r in df.orderBy("page_id").select(pages.status_of(F.col("html"), SITE).alias("x")).collect()] == ["active", "active", "archived", "active"]


def test_cards_under_one_parent(spark):
    """Against all pairs; what is under a very common parent is summed up by hash before it is shuffled, and nothing is sorted for it."""
    rng = random.Random(3)
    some = lambda n: [("https://s.test/" + "/".join(rng.choice("ab") for _ in range(rng.randint(0, 4))), rng.choice([None, *range(9)])) for _ in range(n)] + [(f"https://s.test/hot/{k}", k) for k in range(2 * n, 3 * n)]
    asked, have = some(60), some(40)
    details = spark.createDataFrame([(k, u, None) for k, (u, _) in enumerate(asked)], "page_id int, url string, price long")
    found = pages.match_cards(details, spark.createDataFrame(have, "url string, price long"))
    least: dict = {}
    for u, p in have:
        if p is not None:
            least[u.rstrip("/")] = min(p, least.get(u.rstrip("/"), p))

    def best(u):
        u = u.rstrip("/")
        fits = [(u == c, min(len(u), len(c)), -p, p) for c, p in least.items() if u == c or u.startswith(c + "/") and c.count("/") > 2 or c.startswith(u + "/") and u.count("/") > 2]
        return max(fits)[3] if fits else None

    assert {r["page_id"]: r["price"] for r in found.collect()} == {k: best(u) for k, (u, _) in enumerate(asked)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_fresh_copy(spark):
    t = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([("a", "old", t - dt.timedelta(hours=2)), ("a", "new", t), ("b", "old", t - dt.timedelta(hours=2))], "url string, html string, fetched_at timestamp")
    assert [(r["url"], r["html"]) for r in pages.fresh_copy(df, F.lit(t)).collect()] == [("a", "new")]


def test_balanced_json():
    assert pages.balanced_json('x m = {"a": "}\\"{", "b": {}} {', "m") == '{"a": "}\\"{", "b": {}}'
    assert pages.balanced_json("m {", "m") is None and pages.balanced_json(None, "m") is None


def test_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"source":"a","url":"u","title":"t","price":5}\n{"source":"a","url":"v","title":"t"}\n')
    df = files.read_snapshot(spark, str(tmp_path / "s.json"), "source string, url string, title string, price long, rooms int, area double")
    assert [len(r["listing_key"]) for r in df.collect()] == [16]
    rows = spark.createDataFrame([("x", 1.5, "k", "t"), ("y", None, "k", "t")], "z string, price double, row_key string, title string")
    assert files.write_features(rows, str(tmp_path / "f"), ["price"]) == 2
    back = files.read_features(spark, str(tmp_path / "f"))
    assert back.columns == ["price", "row_key", "title", "z"] and [r["price"] for r in back.collect()] == [1.5]
    both = files.build_dataset(rows, rows.drop("z"), with_price_only=True)
    assert both.count() == 2


def test_reports(spark):
    df = spark.createDataFrame([("a", 250000, 2, None, "", "u", ["http://1", " http://1", "x", "http://2"]), ("b", None, None, 5.0, "A", "v", ["http://3", "http://4"])], "title string, price int, rooms int, area double, address string, url string, photos array<string>")
    blocks = files.report_blocks(df, [F.col("title")]).orderBy("n").collect()
    assert blocks[0]["block"].startswith("1. a\nprice: 250 000\nrooms: 2, area: —\naddress: —") and "price: —" in blocks[1]["block"]
    assert [r["photos"] for r in files.report_table(df, [F.col("title")], 2, 3).orderBy("title").collect()] == [["http://1", "http://2"], ["http://3"]]


@pytest.mark.parametrize("a, b, want", [(["x", "y"], ["y", "z"], ["x", "y", "z"]), (None, ["z"], ["z"])])
def test_merged_photos(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(files.merged_photos(F.col("a"), F.col("b")).alias("x")).first()["x"] == want
