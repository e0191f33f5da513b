import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from flatlake.functions import dates, numbers, phones, tags, texts

TODAY = dt.date(2024, 8, 15)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[0] for v in values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.fixture
def of(spark):
    return lambda f, text: one(spark, f(F.col("t")), t=(text, "string"))


@pytest.mark.parametrize("text, want", [("150 000 T", 150000), ("", None), (None, None), ("no", None)])
def test_parse_int(of, text, want):
    assert of(numbers.parse_int, text) == want


@pytest.mark.parametrize("text, want", [("43,5 м", 43.5), ("7", 7.0), ("x", None)])
def test_parse_float(of, text, want):
    assert of(numbers.parse_float, text) == want


@pytest.mark.parametrize("text, want", [("2 комн. квартира", 2), ("3-к кв", 3), ("Студия", 0), ("4", 4), (None, None)])
def test_parse_rooms(of, text, want):
    assert of(numbers.parse_rooms, text) == want


@pytest.mark.parametrize("text, want", [("5/9", (5, 9)), ("196/17", (None, None)), ("7 эт", (7, None)), ("", (None, None))])
def test_parse_floor_pair(of, text, want):
    assert tuple(of(numbers.parse_floor_pair, text)) == want


@pytest.mark.parametrize("text, want", [("484", 484), ("1.2K", 1200), ("12K", 12000)])
def test_view_count(of, text, want):
    assert of(numbers.view_count, text) == want


@pytest.mark.parametrize("m, want", [(852.0, "850 м"), (1234.0, "1,2 км"), (1000.0, "1,0 км")])
def test_distance_text(spark, m, want):
    assert one(spark, numbers.distance_text(F.col("m")), m=(m, "double")) == want


def test_half_even(spark):
    assert one(spark, numbers.converted(F.col("p"), F.lit(0.5)), p=(5, "long")) == 2


@pytest.mark.parametrize("text, want", [
    ("8 (707) 123-45-67", "+77071234567"), ("+7 707 123 45 67", "+77071234567"), ("7071234567", "+77071234567"), ("007 707 123 45 67", "+77071234567"),
    ("https://wa.me/77071234567 8 701 000 00 00", "+77071234567"), ("123", ""), ("0071234567", ""),
])
def test_normalize_phone(of, text, want):
    assert of(phones.normalize_phone, text) == want


@pytest.mark.parametrize("html, want", [
    ('<a href="tel:+7 707 123 45 67">x</a>', ("+77071234567", "tel_link")), ('<button>Показать телефон 8 705 111 22 33</button>', ("+77051112233", "button")),
    ('<div data-phone="8 (705) 111-22-33"></div>', ("+77051112233", "data_attr")), ('{"phone": "+7 705 111 22 33"}', ("+77051112233", "json_state")),
    ("<p>звоните 8 705 111 22 33</p>", ("+77051112233", "visible_text")), ("<p>8***</p>", ("", "")), (None, ("", "")),
    ("<script>var x = 'ODcwNTExMTIyMzMgICAgICAg'</script>", ("+77051112233", "js_script")),
])
def test_contact_phone(of, html, want):
    assert tuple(of(phones.contact_phone, html)) == want


def test_barred_phone(of):
    assert of(lambda c: phones.contact_phone(c, ["+77071234567"]), '<a href="tel:+77071234567">x</a> 8 705 111 22 33')["phone"] == "+77051112233"


@pytest.mark.parametrize("text, want", [
    ("Сегодня", TODAY), ("вчера", TODAY - dt.timedelta(1)), ("Позавчера", TODAY - dt.timedelta(2)), ("5 авг", dt.date(2024, 8, 5)), ("5 августа 2023", dt.date(2023, 8, 5)),
    ("август 5, 2023", dt.date(2023, 8, 5)), ("2023-08-05", dt.date(2023, 8, 5)), ("05.08.23", dt.date(2023, 8, 5)), ("31 февраля", None), ("3/5", None), (None, None),
])
def test_parse_date(of, text, want):
    assert of(lambda c: dates.parse_date(c, F.lit(TODAY)), text) == want


@pytest.mark.parametrize("text, want", [
    ("размещено 1 августа, обновлено 5 августа", (dt.date(2024, 8, 1), dt.date(2024, 8, 5))), ("обновлено: 5 августа", (None, dt.date(2024, 8, 5))),
    ("01.08.2024 x 02.08.2024", (dt.date(2024, 8, 1), dt.date(2024, 8, 2))), ("нет", (None, None)),
])
def test_extract_dates(of, text, want):
    assert tuple(of(lambda c: dates.extract_dates(c, F.lit(TODAY)), text)) == want


@pytest.mark.parametrize("text, want", [("250 000 тг в месяц", 250000), ("сдам за 180к", 180000), ("200 тыс", 200000), ("цена 55 000 + ком", 55000), ("5 минут до метро", None), ("лицей 90", None)])
def test_rent_price(of, text, want):
    assert of(texts.rent_price, text) == want


@pytest.mark.parametrize("text, want", [("2-комнатная", 2), ("двухкомнатная", 2), ("3 бөлмелі", 3), ("студия у парка", 0), ("екі бөлмелі", 2), ("дом", None)])
def test_rooms_in_text(of, text, want):
    assert of(texts.rooms_in_text, text) == want


@pytest.mark.parametrize("text, want", [("43/27/6", 43.0), ("площадь 45,5 м²", 45.5), ("45 шаршы", 45.0), ("5 м2", None)])
def test_area_in_text(of, text, want):
    assert of(texts.area_in_text, text) == want


@pytest.mark.parametrize("text, want", [("4/9 этаж", (4, 9)), ("5 эт", (5, None)), ("9/4 этаж", (4, None)), ("", (None, None))])
def test_floor_in_text(of, text, want):
    assert tuple(of(texts.floor_in_text, text)) == want


@pytest.mark.parametrize("text, want", [
    ("Сниму квартиру", "WANTED"), ("квартира посуточно", "SHORT_TERM"), ("ищем девушку на подселение", "ROOMMATE"), ("сдаю комнату", "SUBLET"), ("частный дом", "HOUSE"),
    ("комната в центре", "PRIVATE_ROOM"), ("2-комн квартира", "WHOLE_APARTMENT"), ("привет", "UNKNOWN"),
])
def test_listing_type(of, text, want):
    assert of(texts.listing_type, text) == want


#: What each text says about costs; fields that aren't named are null, false or unknown.
COSTS = [
    ("Аренда 250 000 тг, депозит 100 000 тг возвратный, комиссия 50%, коммунальные 15 - 25 тыс", {"deposit": 100_000, "deposit_refundable": True, "commission_percent": 50, "utilities": "separate", "utilities_min": 15_000, "utilities_max": 25_000}),
    ("коммунальные услуги 15 000 - 25 000", {"utilities": "separate", "utilities_min": 15_000, "utilities_max": 25_000}),
    ("коммунальные 15-25к", {"utilities": "separate", "utilities_min": 15_000, "utilities_max": 25_000}),
    ("комуслуги: ком. услуги 20000", {"utilities": "separate"}),
    ("всё включено 200 000", {"utilities": "included"}),
    ("коммунальные 15000-25000, все включено", {"utilities": "included"}),
    ("комиссия 100 000 тенге наличными, агент 30%", {"commission_fixed": 100_000, "commission_percent": 30}),
    ("комиссия 100 000, агент 30%", {"commission_percent": 30}),
    ("комиссия 30% или комиссия 40000", {"commission_percent": 30, "commission_fixed": 40_000}),
    ("заезд 150 тыс", {"first_payment": 150_000}),
    ("60 000 с человека", {"price_per_person": True}),
    ("депозит 3 000 тг, депозит 80к", {"deposit": 80_000}),
    ("посуточно, депозит 50 000", {}),
    ("депозит " + "9" * 30, {}),
    ("x" * 5000 + " залог 90000 " + "y" * 5000, {"deposit": 90_000}),
    ("1 " * 500 + "залог 70000", {"deposit": 70_000}),
    ("", {}), (None, {}),
]


@pytest.mark.parametrize("text, want", COSTS)
def test_costs(of, text, want):
    got = of(texts.costs, text).asDict()
    assert {k: v for k, v in got.items() if v not in (None, False, "unknown")} == want and set(got) == set(texts.COSTS) and got["price_per_person"] is not None


def test_glossary(of):
    assert of(texts.translated, "2 бөлмелі пәтер жалға беріледі, депозит жоқ, жаңа ремонт, үй") == "2 комнатная квартира сдаётся, без депозита, новый ремонт, үй"


@pytest.mark.parametrize("hours, want", [(1, 1.0), (5, 0.95), (11, 0.9), (23, 0.8), (47, 0.6), (167, 0.3), (200, 0.1), (-5, 1.0)])
def test_freshness(spark, hours, want):
    now = dt.datetime(2024, 8, 15, 12)
    assert one(spark, texts.freshness(F.col("p"), F.lit(now)), p=(now - dt.timedelta(hours=hours), "timestamp")) == want


@pytest.mark.parametrize("text, want", [("я собственник", 0.85), ("агентство, комиссия", 0.15), ("", 0.5), ("собственник, без риелтор", 0.5)])
def test_owner(of, text, want):
    assert of(texts.owner_probability, text) == want


def test_tags(spark):
    text = "Евроремонт, студия с балконом, стиральная машина, wi-fi, лифт, рядом с метро, дом 2015 года постройки, потолки 3,2 м, без мебели"
    row = spark.createDataFrame([("t", text), (None, None)], "title string, description string")
    row = tags.with_tags(row).collect()
    r = row[0]
    assert all(r[f"tag_{t}"] for t in ("euro_renovation", "studio", "balcony", "washer", "wifi", "elevator", "near_metro", "unfurnished")) and not r["tag_garage"] and not r["tag_gym"]
    assert (r["renovation_grade"], r["furniture_level"], r["year_built"], r["ceiling_height"]) == (3, "none", 2015, 3.2)
    assert not any(row[1][c] for c in row[1].asDict() if c.startswith("tag_")) and row[1]["renovation_grade"] is None
    assert len([c for c in r.asDict() if c.startswith("tag_")]) == 63


def test_fields_of_messages(spark):
    rows = [("Сдается 2-комнатная квартира, ул. Абая\n250 000 тг, 5/9 этаж, 60 м2\n@owner_chat https://2gis.kz/almaty/geo/1?m=43.25,76.9",), ("обсудим погоду",)]
    got = texts.fields(spark.createDataFrame(rows, "text string")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["price"], r["rooms"], r["area"], r["floor"], r["total_floors"], r["contact_telegram"], r["lat"]) == (250000, 2, 60.0, 5, 9, "owner_chat", 43.25)


def test_sql_functions(spark):
    from flatlake.functions.sqlfuncs import register

    assert "fl_haversine" in register(spark)
    r = spark.sql("""SELECT fl_canonical_phone('8 707 123 45 67') p, fl_price_band(258000) b, fl_listing_key('a', NULL, 'c') k, fl_listing_type('ищем девушку на подселение') t, fl_owner_probability('я собственник', false) o,
      fl_fingerprint('Абая 1', 2, 60.5D, NULL, 258000) f, fl_in_polygon(1D, 1D, array(named_struct('lat', 0D, 'lon', 0D), named_struct('lat', 0D, 'lon', 3D), named_struct('lat', 3D, 'lon', 0D))) i""").first()
    assert (r["p"], r["b"], len(r["k"]), r["t"], r["o"], r["f"], r["i"]) == ("+77071234567", 240000, 16, "ROOMMATE", 0.85, "абая 1|2|60|_|240000", True)


def plain_dates(text):
    """published and updated of dotted dates, by their places in the text."""
    published = updated = None
    for m in re.finditer(r"(?<![0-9])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])", text):
        near, on = text[max(0, m.start() - 14) : m.end() + 4], dt.datetime.strptime(m[0], "%d.%m.%Y").date()
        label = "u" if "обнов" in near else "p" if re.search("публик|размест|создан|добав", near) else ""
        if label == "p" or label == "" and published is None:
            published = published or on
        else:
            updated = updated or on
    return published, updated


def test_dates_side_by_side(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["обновлено ", "обнов. ", "размещено ", "создан ", " ", ", ", "x", "", "дом у реки "])
    texts = ["".join(word() + f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.20{rng.randint(10, 24)}" + word() for _ in range(rng.randint(0, 4))) for _ in range(150)] + ["", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(dates.extract_dates(F.col("t"), F.lit("2024-08-15").cast("date")).alias("d"), "t").collect()
    assert [(r["d"]["published"], r["d"]["updated"]) if r["t"] is not None else (None, None) for r in got] == [plain_dates(t or "") for t in texts]


def test_stems_are_in_every_match():
    import regex

    assert tags.stems(r"два? санузл|2\s*с/у|ст\.?\s*машин|\bтв\b|a{2}bc(?:d|ef)|[xy]z?q") == [" санузл", "с/у", "машин", "тв", "bc", "q"]
    patterns = [*tags.PATTERNS.values(), *(p for rules in (tags.RENOVATION, tags.FURNITURE, tags.BUILDING) for _, _, p in rules if p)]
    rng = random.Random(1)
    for pattern in patterns:
        known = tags.stems(pattern)
        assert all(known)
        for branch, stem in zip(pattern.split("|") if "(" not in pattern else [pattern] * len(known), known, strict=True):
            made = regex.sub(r"\\s\*|\\s\+", " ", branch).replace("\\w+", "ая").replace("\\w*", "").replace("\\b", "").replace("\\.?", ".").replace("\\d", "1")
            if regex.search(branch, made) and "(" not in pattern:
                assert stem in made, (branch, made)
        text = "".join(rng.choice([*known, " ", "ый", "x"]) for _ in range(30))
        if regex.search(pattern, text):
            assert any(k in text for k in known)


def test_barred_numbers_in_one_pass(spark):
    """All rows once, with one join, whatever their numbers; those without one are left alone and don't meet in one task."""
    rows = spark.createDataFrame([(1, "8 707 123 45 67"), (2, None), (3, ""), (4, "no number"), (5, "+7 (705) 000-00-01"), (6, "wa.me/77071234567")], "id long, phone string")
    barred = spark.createDataFrame([("+7-707-123-45-67",), (None,), ("",)], "phone string")
    got = phones.without_barred(rows, barred)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan
    assert sorted(map(tuple, got.collect())) == [(1, ""), (2, None), (3, ""), (4, "no number"), (5, "+7 (705) 000-00-01"), (6, "")]


def test_bare_rents_are_looked_for_where_they_may_be(spark):
    """A number without a unit is a rent near a word of rent alone; a text without such a word isn't searched by stretches."""
    import time

    said = {"оплата 150000": 150000, "оплата" + "." * 60 + " 25": None, "150 000": 150000, "цена 45.000 в": 45000, "номер 150": None, "": None, "цена сто": None}
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", texts.rent_price(F.col("t")).alias("p"))
    assert {r["t"]: r["p"] for r in got.collect()} == said
    long = spark.createDataFrame([("проза " * 700_000,)], "t string").select(texts.rent_price(F.col("t")).alias("p"))
    began = time.time()
    assert long.first()["p"] is None and time.time() - began < 60
