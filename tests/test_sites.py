"""Pages of each source, written here in the shape that the source has."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flatlake.sources import sites

CARDS = {
    "krisha": """<div class="a-card is-visible"><div class="a-card__image"><picture><source srcset="https://p.test/1-400x300.webp 1x, https://p.test/b.webp 2x"><img src="https://p.test/1-400x300.jpg"></picture><img src="/static/hot.svg"></div>
      <a class="a-card__title" href="/a/show/1">2-комнатная квартира · 60.5 м² · 5/9 этаж</a><div class="a-card__price">250 000 <span>〒</span></div><div class="a-card__subtitle">Алмалы, Абая 1</div><div class="a-card__text-preview">Уютная</div>опубликовано 01.08.2024</div>
      <div class="a-card"><a class="a-card__title" href="/a/show/2"></a></div><div class="a-card"><a href="https://krisha.kz/a/show/3" class="big a-card__title">Дом</a><p>в 5 минутах, 3 м</p></div>""",
    "olx": """<div data-cy="l-card" id="1"><a href="/d/obyavlenie/x"><img srcset="https://p.test/a;s=200x1 200w,https://p.test/a;s=500x1 500w"></a><div data-testid="ad-card-title"><a href="/d/obyavlenie/x"><h4>3-комн квартира</h4></a></div><p data-testid="ad-price">300 000 тг.</p>
      <p data-testid="location-date">Алматы, Бостандык - Сегодня в 14:32</p><span>70 м²</span></div><div data-cy="l-card"><h6><a href="https://www.olx.kz/d/obyavlenie/y">Комната</a></h6><div class="price">90 000</div></div>""",
    "kn": """<div data-object-id="7"><a href="/card/7"><img src="https://p.test/m.jpg">16 фото</a><a href="/card/7">2-комнатная квартира, ул. Халиуллина, 196/17</a><span>210 000 ₸</span><span class="fw-bold">45 м²</span><span>площадь</span><span class="fw-bold">1/5</span><span>этаж</span></div>""",
    "etagi": """<div data-testid="object_card"><a href="/realty_rent/55/"></a><span data-testid="slider_counter">1/14</span><img src="//cdn.esoft.digital/320240/cluster/photos/h/f.jpeg"><div data-testid="object_card_price">230 000 ₸</div><span>2-комн. кв. 52 м² 3/5 эт.</span><div class="address">Абая , 5</div></div>""",
}
WANT = {
    "krisha": [("https://krisha.kz/a/show/1", "2-комнатная квартира · 60.5 м² · 5/9 этаж", 250000, 2, 60.5, 5, 9, "Алмалы, Абая 1", ["https://p.test/1-400x300.webp"]), ("https://krisha.kz/a/show/3", "Дом", None, None, None, None, None, "", [])],
    "olx": [("https://www.olx.kz/d/obyavlenie/x", "3-комн квартира", 300000, 3, 70.0, None, None, "Алматы, Бостандык", ["https://p.test/a"]), ("https://www.olx.kz/d/obyavlenie/y", "Комната", 90000, None, None, None, None, "", [])],
    "kn": [("https://www.kn.kz/card/7", "2-комнатная квартира, ул. Халиуллина, 196/17", 210000, 2, 45.0, 1, 5, "ул. Халиуллина, 196/17", ["https://p.test/m.jpg"])],
    "etagi": [("https://almaty.etagi.com/realty_rent/55/", "2-комн. кв., 52 м², 3/5 эт., Абая , 5", 230000, 2, 52.0, 3, 5, "Абая , 5", ["https://cdn.esoft.digital/content/cluster/photos/h/f.jpeg"])],
}


@pytest.mark.parametrize("name", sorted(CARDS))
def test_cards(spark, name):
    pages = spark.createDataFrame([(1, CARDS[name]), (2, None), (3, "")], "page_id long, html string")
    got = sites.listings(pages, sites.SITES[name], F.lit("2024-08-15").cast("date")).orderBy("card_no").collect()
    assert [(r["url"], r["title"], r["price"], r["rooms"], r["area"], r["floor"], r["total_floors"], r["address"], r["photos"]) for r in got] == WANT[name]
    if name == "krisha":
        assert got[0]["date_published"] == dt.date(2024, 8, 1) and got[0]["description"] == "Уютная"


LD = '<script type="application/ld+json">{"@type":"Product","offers":{"price":"120000"}}</script>'
DETAILS = [
    ("krisha", '<script id="jsdata">{"status":"live","price":650000,"map":{"zoom":1,"lat":43.25,"lon":76.9}}</script>', (650000, 43.25, 76.9, "active")),
    ("krisha", '{"status":"archive","price":1}', (1, None, None, "archived")),
    ("krisha", "Объявление может быть неактуальным", (None, None, None, "outdated")),
    ("olx", LD + '<i>{"lat":43.2,"lon":76.8}</i>', (120000, 43.2, 76.8, "active")),
    ("olx", '<div data-testid="ad-price">99 000 тг</div>', (99000, None, None, "active")),
    ("olx", "Объявление больше не доступно", (None, None, None, "gone")),
    ("kn", LD, (120000, None, None, "active")),
    ("kn", '<div class="kn-fs-26">77 000</div><i data-x-latitude-value="43.1" data-x-longitude-value="76.7">', (77000, 43.1, 76.7, "active")),
    ("kn", "Тут&nbsp;пусто Ошибка 404", (None, None, None, "gone")),
    ("etagi", '<script>var data={"price":230000,"la":"43.2","lo":76.9,"t":"a}\\"{"};</script>', (230000, 43.2, 76.9, "active")),
    ("etagi", None, (None, None, None, "active")),
]


@pytest.mark.parametrize("name, html, want", DETAILS)
def test_details(spark, name, html, want):
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    r = sites.detail(pages, sites.SITES[name]).first()
    assert (r["price"], r["lat"], r["lon"], r["status"]) == want


def test_galleries(spark):
    html = """<img src="//a.test/1-120x90.webp"><img src="//a.test/1-120x90.jpg"><img src="/static/x.png"><img data-src="https://a.test/gallery_big/2.jpg"><img src="//cdn.esoft.digital/640480/cluster/photos/h/f.jpeg"><img src="//cdn.esoft.digital/320240/cluster/photos/h/f.jpeg">"""
    got = spark.createDataFrame([(html,)], "html string").select(*(sites.gallery(F.col("html"), s).alias(n) for n, s in sites.SITES.items())).first()
    assert got["krisha"][0] == "https://a.test/1-750x470.webp" and len(got["krisha"]) == 4
    assert got["kn"] == ["https://a.test/gallery_big/2.jpg"] and got["etagi"] == ["https://cdn.esoft.digital/content/cluster/photos/h/f.jpeg"]


def test_rents(spark):
    state = {"lists": {"rents": [
        {"_ticket_id": 5, "rooms": 2, "square": "52.0", "floor": 3, "floors": 5, "price": 230000, "la": "43.2", "lo": "", "meta": {"street": "Абая"}, "house_num": "7", "main_photo": "p"}, {"_ticket_id": 6, "studio": True, "type": "apart"}, {"x": 1},
    ]}}
    pages = spark.createDataFrame([(1, f"<script>var data={json.dumps(state)};var x={{}}</script>"), (2, "var data={broken"), (3, None)], "page_id long, html string")
    got = sites.rents(pages).orderBy("card_no").collect()
    assert [(r["url"][-15:], r["title"], r["price"], r["lat"], r["lon"], r["photos"]) for r in got] == [
        ("/realty_rent/5/", "2-комн. кв., 52 м², 3/5 эт., Алматы, Абая, д. 7", 230000, 43.2, None, ["p"]), ("/realty_rent/6/", "Апартаменты, Алматы", None, None, None, []),
    ]


def test_dehydrated(spark):
    item = {
        "product": {"id": "9", "name": "Квартира", "description": "2-комн, 5/9 этаж, 40 м2 'уют'", "attributes": [{"caption": "Количество комнат", "value": "3"}, {"caption": "Общая площадь", "value": "61,5 м²"}, {"caption": "Этажность", "value": 12}]},
        "offer": {"price": {"value": 350000}, "url": "https://u.test"}, "branch": {"id": "b", "org": "o"}, "building": {"id": "h", "address_name": "Абая 1"},
    }
    state = {"mutations": [], "queries": [{"queryKey": ["other"], "state": {"data": {"items": [{}]}}}, {"queryKey": ["getRealtyItems/x"], "state": {"data": {"items": [item, {}]}}}]}
    quoted = json.dumps(state, ensure_ascii=False).replace("\\", "\\\\").replace("'", "\\'")
    pages = spark.createDataFrame([(1, f"<script>window.s = JSON.parse('{quoted}')</script>"), (2, "none"), (3, None)], "page_id long, html string")
    got = sites.dehydrated(pages).orderBy("card_no").collect()
    r = got[0]
    assert len(got) == 2 and (r["price"], r["currency"], r["rooms"], r["area"], r["floor"], r["total_floors"], r["address"]) == (350000, "тг", 3, 61.5, 5, 12, "Абая 1")
    assert (r["url"], r["source_listing_id"], r["provider_org_id"], r["provider_branch_id"], r["building_id"]) == ("https://u.test", "9", "o", "b", "h")
