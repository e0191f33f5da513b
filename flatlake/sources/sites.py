"""The page sources that the library reads: where each keeps its cards, fields, states and pictures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import extract_dates
from ..functions.numbers import clean_space, found, parse_float, parse_floor_pair, parse_int, parse_rooms
from .markup import Pick, cards
from .pages import Site, absolute, embedded_state, is_category_page, unquoted_state, visible

#: An area: the raised sign is wanted, and no letter may follow, so that "5 мин" isn't one.
AREA = r"([0-9.,]+\s*м[²^2·•])(?![а-яё])"
STREET = r"(?iU)ул(?:ица)?\.?|пр(?:оспект)?\.?|ш(?:оссе)|б-р\.?|мкр\.?"


def tag(mark: str, name: str = r"[a-z][a-z0-9]*") -> str:
    """The inside of the first element whose opening tag has `mark`, up to the next end of a block, link or span."""
    return rf"(?is)<(?:{name})(?=[^>]*{mark})[^>]*>(.*?)</(?:div|p|span|a|h[1-6]|strong|li)>"


def has_class(name: str) -> str:
    return rf"\bclass=\"(?:[^\"]*\s)?{name}(?:\s[^\"]*)?\""


OLX_LINKS = ("[data-testid=ad-card-title] a", "a[data-cy=ad-href]", "h6 a", "a[href*=/d/obyavlenie/]")

#: Marks of cards and fields, and words of pages, source by source.
SITES: dict[str, Site] = {
    "krisha": Site(
        "krisha", "https://krisha.kz", marks=("div.a-card",),
        picks={"url": (Pick("a.a-card__title", "href"),), "title": (Pick("a.a-card__title"),), "price": (Pick(".a-card__price"),), "address": (Pick(".a-card__subtitle"),), "preview": (Pick(".a-card__text-preview"),)},
        photo=r"(?is)<(?:img|source)\b[^>]*?(?:srcset|src|data-src|data-full-src)=[\"']([^\"'\s,]+)", skip=r"/static/|\.svg$|^data:", cap=10,
        archived=r"\"status\"\s*:\s*\"archive\"", outdated="is-archived-text|может быть неактуальным",
    ),
    "olx": Site(
        "olx", "https://www.olx.kz", fields={"price": rf"{tag('data-testid=.ad-price.')}|{tag(has_class('price'))}"}, marks=("div[data-cy=l-card]", "div.offer-wrapper"),
        picks={
            "url": tuple(Pick(x, "href", text=r"\w") for x in OLX_LINKS), "title": tuple(Pick(x, text=r"\w") for x in OLX_LINKS),
            "price": (Pick("[data-testid=ad-price]"), Pick("p.price strong"), Pick(".price")), "address": tuple(map(Pick, ("[data-testid=location-date]", "[data-cy=location]", "p small", ".l-height small"))),
        },
        photo=r"(?is)<img\b[^>]*?(?:\bsrcset=\"(?:[^\"]*,\s*)?|\b(?:src|data-src)=[\"'])([^\"'\s,]+)", skip="no_thumbnail|^data:", size=(r";.*$", ""), live=("data-testid=.ad-price", r"\"offers\""), cut_address=" - ",
    ),
    "kn": Site(
        "kn", "https://www.kn.kz", marks=("div[data-object-id]", "div[class*=kn-shadow-hover]"),
        picks={
            "url": (Pick("a[href*=/card/]", "href", text=".{11}"),), "title": (Pick("a[href*=/card/]", text=".{11}"),), "price": (Pick("span", text=r"^[0-9\s]{4,}\s*[₸т]|^(?=.{1,24}$).*[0-9]{4}"),),
            "floor": (Pick("span.fw-bold", text=r"^[0-9]{1,2}\s*/\s*[0-9]{1,2}", after="этаж"),), "area": (Pick("span.fw-bold", text=r"[0-9]\s*м²"),),
        },
        photo=r"(?is)<img\b[^>]*?\b(?:src|data-src)=[\"']([^\"']+)", skip="^data:", cap=10, gallery="/gallery_big/", street_of_title=True,
        gone="тут пусто|ошибка 404|страницы либо не существует|срок объявления уже истек",
    ),
    "etagi": Site(
        "etagi", "https://almaty.etagi.com", marks=("[data-testid=object_card]", "div.templates-object-card"),
        picks={"url": (Pick("a[href*=/realty_rent/]", "href"),), "title": (Pick("a.card-title"),), "price": (Pick("[data-testid=object_card_price]"),), "address": (Pick("div.address"), Pick(".EDAsp")), "counter": (Pick("[data-testid=slider_counter]"),)},
        photo=r"(?is)<(?:img|source)\b[^>]*?\b(?:src|data-src|srcset)=[\"']([^\"'\s,]+)", skip="^data:", gallery="cdn.esoft.digital", size=(r"//cdn\.esoft\.digital/[0-9]+x?[0-9]*/cluster/", "//cdn.esoft.digital/content/cluster/"), floor_mark=r"(?i)([0-9]{1,2}\s*/\s*[0-9]{1,2})\s*эт", title_of_fields=True,
    ),
}


def street_of(title: Column) -> Column:
    """The part of a title between commas that names a street, with a house number that follows it."""
    plain = F.regexp_replace(F.regexp_replace(title, r"[0-9.,]+\s*м[²^2·•]\s*", " "), r"(?U)[0-9]{1,2}\s*/\s*[0-9]{1,2}\s*эт\w*", " ")
    parts = F.filter(F.transform(F.split(plain, ","), lambda x: F.trim(x)), lambda p: p != "")
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.get(parts, i + 1).alias("next")))
    first = F.get(F.filter(numbered, lambda x: x["p"].rlike(STREET)), F.lit(0))
    return F.concat(first["p"], F.when(first["next"].rlike(r"^[0-9]+(?:/[0-9]+)?$"), F.concat(F.lit(", "), first["next"])).otherwise(""))


@F.udtf(returnType="card_no int, card string, text string, fields map<string, string>", useArrow=True)
class PageCards:
    """page_cards(html, source): the cards of a page of one of SITES, with their text and that of each field that is there."""

    def eval(self, html: str, source: str):
        if source in SITES:
            yield from cards(html, SITES[source].marks, SITES[source].picks)


def register(spark: SparkSession, name: str = "page_cards") -> None:
    """For SQL: SELECT ... FROM pages, LATERAL page_cards(html, source)."""
    spark.udtf.register(name, PageCards)


def cards_of(pages: DataFrame, source: Column) -> DataFrame:
    """page_id, card_no, card, text and fields of the cards of each page (page_id, html and what source takes)."""
    own = pages.select("page_id", "html", source.alias("__source"))
    return own.lateralJoin(PageCards(F.col("html").outer(), F.col("__source").outer())).select("page_id", "card_no", "card", "text", "fields")


def listings(pages: DataFrame, site: Site, today: Column) -> DataFrame:
    """page_id, card_no and a listing row for each card of a source's pages; cards without a link or a title go."""
    each = cards_of(pages.filter(is_category_page(F.col("html"), site.markers)), F.lit(site.source))
    get = lambda name: F.try_element_at("fields", F.lit(name))
    rows = each.select("page_id", "card_no", "card", "fields", absolute(get("url"), site.base).alias("url"), get("title").alias("__title"), get("counter").alias("__counter"), F.col("text").alias("__text"))
    text = F.when(F.coalesce(F.col("__counter"), F.lit("")) != "", F.replace("__text", F.col("__counter"), F.lit(" "))).otherwise(F.col("__text"))
    title = F.nullif(F.col("__title"), F.lit(""))
    address = get("address") if not site.street_of_title else street_of(title)
    address = F.trim(F.split_part(address, F.lit(site.cut_address), F.lit(1))) if site.cut_address else address
    marked = parse_floor_pair(found(text, site.floor_mark)) if site.floor_mark else parse_floor_pair(get("floor"))
    pairs = [marked, parse_floor_pair(title), parse_floor_pair(text)]
    pair = F.coalesce(*(F.when(p["floor"].isNotNull(), p) for p in pairs))
    areas = [parse_float(get("area")), parse_float(found(title, AREA)), parse_float(found(text, AREA))]
    photos = F.transform(F.regexp_extract_all("card", F.lit(site.photo), 1), lambda u: absolute(u, site.base))
    dated = extract_dates(text, today)
    own = rows.select(
        "page_id", "card_no", F.lit(site.source).alias("source"), "url", title.alias("title"), parse_int(get("price")).alias("price"), F.coalesce(parse_rooms(title), parse_rooms(found(text, r"(?iU)([0-9]+\s*-?\s*комн\w*)"))).alias("rooms"),
        F.coalesce(*areas).alias("area"), pair["floor"].alias("floor"), pair["total"].alias("total_floors"), F.coalesce(address, F.lit("")).alias("address"), pictures(photos, site).alias("photos"),
        F.coalesce(get("preview"), F.lit("")).alias("description"), dated["published"].alias("date_published"), dated["updated"].alias("date_updated"),
    )
    if site.title_of_fields:
        said = lambda c: F.col(c).cast("string")
        made = F.concat_ws(", ", F.when(F.col("rooms") == 0, "Студия").when(F.col("rooms") > 0, F.concat(said("rooms"), F.lit("-комн. кв."))), F.when(F.col("area") > 0, F.concat(F.regexp_replace(said("area"), r"\.0$", ""), F.lit(" м²"))), F.when(F.col("floor") > 0, F.concat(F.concat_ws("/", said("floor"), said("total_floors")), F.lit(" эт."))), F.nullif("address", F.lit("")))
        own = own.withColumn("title", F.coalesce("title", F.nullif(made, F.lit(""))))
    return own.filter("url IS NOT NULL AND title IS NOT NULL")


def _first(html: Column, pattern: str) -> Column:
    """The value of whichever group of the first match has one."""
    groups = len(re.findall(r"(?<!\\)\((?!\?)", pattern))
    return F.coalesce(*(found(html, pattern, g) for g in range(1, groups + 1)))


def _state(v: str, *paths: str, kind: str = "string") -> Column:
    return F.coalesce(*(F.try_variant_get(v, f"$.{p}", kind) for p in paths))


def _number(v: str, *paths: str) -> Column:
    return parse_float(_state(v, *paths))


def rents(pages: DataFrame, site: Site = SITES["etagi"]) -> DataFrame:
    """page_id, card_no and a listing row of each rent in the page's own state; better than its cards, where there is one."""
    v = pages.select("page_id", F.try_parse_json(embedded_state("var data")(F.col("html"))).alias("v"))
    each = v.select("page_id", F.posexplode(F.try_variant_get("v", "$.lists.rents", "array<variant>")).alias("card_no", "i"))
    ticket, house = _state("i", "_ticket_id"), F.nullif(F.trim(_state("i", "house_num")), F.lit(""))
    address = F.concat_ws(", ", F.coalesce(F.nullif(_state("i", "meta.city"), F.lit("")), F.lit("Алматы")), F.nullif(_state("i", "meta.district"), F.lit("")), F.nullif(_state("i", "meta.street"), F.lit("")), F.concat(F.lit("д. "), house))
    studio = F.coalesce(_state("i", "studio").isin("true", "1"), F.lit(False))
    rooms = F.when(studio, 0).otherwise(_number("i", "rooms").cast("int"))
    apart = F.coalesce(_state("i", "type") == "apart", F.lit(False))
    rows = each.select(
        "page_id", "card_no", F.lit(site.source).alias("source"), F.concat(F.lit(f"{site.base}/realty_rent/"), ticket, F.lit("/")).alias("url"), parse_int(_state("i", "price")).alias("price"), rooms.alias("rooms"),
        _number("i", "square").alias("area"), parse_int(_state("i", "floor")).cast("int").alias("floor"), parse_int(_state("i", "floors")).cast("int").alias("total_floors"), address.alias("address"),
        F.array_compact(F.array(F.nullif(_state("i", "main_photo"), F.lit("")))).alias("photos"), _state("i", "la").try_cast("double").alias("lat"), _state("i", "lo").try_cast("double").alias("lon"), apart.alias("__apart"), ticket.alias("__ticket"),
    )
    said = lambda c: F.col(c).cast("string")
    kind = F.when(F.col("rooms") == 0, F.when(F.col("__apart"), "Апартаменты").otherwise("Студия")).when(F.col("rooms") > 0, F.concat(said("rooms"), F.lit("-комн. "), F.when(F.col("__apart"), "апартаменты").otherwise("кв.")))
    title = F.concat_ws(", ", kind, F.when(F.col("area") > 0, F.concat(F.regexp_replace(said("area"), r"\.0$", ""), F.lit(" м²"))), F.when(F.col("floor") > 0, F.concat(F.concat_ws("/", said("floor"), F.when(F.col("total_floors") > 0, said("total_floors"))), F.lit(" эт."))), F.col("address"))
    return rows.withColumn("title", title).filter("coalesce(__ticket, '') NOT IN ('', '0')").drop("__apart", "__ticket")


#: Words in the captions of attributes.
CAPTIONS = {"rooms": ("комнат|room", ""), "area": ("площад|area", "комнат|room"), "floor": ("этаж", "этажн|комнат|room|площад|area"), "total_floors": ("этажн|floor", "комнат|room|площад|area")}


def dehydrated(pages: DataFrame, key: str = "getRealtyItems") -> DataFrame:
    """page_id, card_no and a listing row of each item in a page's quoted state, of the query whose key begins with `key`. What
    the attributes don't say is read out of the description."""
    from ..functions.texts import area_in_text, floor_in_text, listing_type, rooms_in_text

    v = pages.select("page_id", F.try_parse_json(unquoted_state(F.col("html"))).alias("v"))
    asked = F.filter(F.try_variant_get("v", "$.queries", "array<variant>"), lambda q: F.coalesce(F.try_variant_get(q, "$.queryKey[0]", "string").startswith(key), F.lit(False)) & F.try_variant_get(q, "$.state.data.items[0]", "variant").isNotNull())
    items = F.try_variant_get(F.get(asked, F.lit(0)), "$.state.data.items", "array<variant>")
    each = v.select("page_id", F.posexplode(items).alias("card_no", "i"))
    attributes = F.try_variant_get("i", "$.product.attributes", "array<variant>")

    def attribute(name: str) -> Column:
        words, other = CAPTIONS[name]
        caption = lambda a: F.lower(F.coalesce(F.try_variant_get(a, "$.caption", "string"), F.lit("")))
        mine = lambda a: caption(a).rlike(words) & (~caption(a).rlike(other) if other else F.lit(True)) & F.try_variant_get(a, "$.value", "string").isNotNull()
        found = F.filter(attributes, mine)
        return F.try_variant_get(F.element_at(found, F.when(F.size(found) > 0, -1)), "$.value", "string")  # the last one counts

    text = F.coalesce(_state("i", "product.description"), F.lit(""))
    title = F.coalesce(F.nullif(_state("i", "product.name"), F.lit("")), _state("i", "offer.button_name"), F.lit(""))
    own = floor_in_text(text)
    floor = parse_int(attribute("floor")).cast("int")
    currency = F.upper(F.coalesce(_state("i", "offer.currency"), F.lit("KZT")))
    return each.select(
        "page_id", "card_no", F.lit("2gis").alias("source"), F.coalesce(_state("i", "offer.url"), F.lit("")).alias("url"), title.alias("title"), text.alias("description"),
        parse_int(F.coalesce(F.try_variant_get("i", "$.offer.price.value", "string"), F.try_variant_get("i", "$.offer.price", "string"))).alias("price"), F.when(currency.isin("KZT", "₸"), "тг").otherwise(currency).alias("currency"),
        parse_float(F.coalesce(F.try_variant_get("i", "$.offer.price_per_meter_value.fixed.value", "string"), F.try_variant_get("i", "$.offer.price_per_meter_value.value", "string"), F.try_variant_get("i", "$.offer.price_per_meter_value", "string"))).alias("rent_per_m2"),
        F.coalesce(parse_int(attribute("rooms")).cast("int"), rooms_in_text(text)).alias("rooms"), F.coalesce(parse_float(attribute("area")), area_in_text(text)).alias("area"), F.coalesce(floor, own["floor"]).alias("floor"),
        F.coalesce(parse_int(attribute("total_floors")).cast("int"), F.when(floor.isNull(), own["total"])).alias("total_floors"), F.coalesce(_state("i", "building.address_name"), F.lit("")).alias("address"),
        _state("i", "product.id").alias("source_listing_id"), _state("i", "building.id").alias("building_id"), F.coalesce(_state("i", "branch.org_id"), _state("i", "branch.org")).alias("provider_org_id"), _state("i", "branch.id").alias("provider_branch_id"),
        listing_type(F.concat_ws("\n", title, text)).alias("listing_type"),
    )


def pictures(photos: Column, site: Site) -> Column:
    """A source's pictures in order, each once whatever its size or extension: icons left out, the size put to the large one."""
    kept = F.filter(photos, lambda u: ~F.lower(u).rlike(site.skip)) if site.skip else photos
    large = F.transform(kept, lambda u: F.regexp_replace(u, *site.size)) if site.size else kept
    named = F.transform(large, lambda u: F.regexp_replace(u, r"(?i)\.(?:webp|jpe?g|png|avif)$", ""))
    first = F.filter(F.transform(large, lambda u, i: F.when(F.array_position(named, F.get(named, i)) == i + 1, u)), lambda u: u.isNotNull())
    return F.slice(first, 1, site.cap) if site.cap else first


def gallery(html: Column, site: Site) -> Column:
    """The pictures of a detail page; of sources that mark them, those alone."""
    every = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*?\b(?:src|data-src)=[\"']([^\"']+)"), 1), lambda u: absolute(u, site.base))
    own = F.filter(every, lambda u: u.contains(site.gallery)) if site.gallery else every
    if site.source == "krisha":
        own = F.transform(own, lambda u: F.regexp_replace(u, r"(?i)-[0-9]+x[0-9]+\.(webp|jpe?g|png|avif)$", "-750x470.$1"))
    return pictures(own, site)


def detail(pages: DataFrame, site: Site) -> DataFrame:
    """page_id, url, price, lat, lon, status of a source's detail pages. Prices come from where the source keeps them: its
    JSON-LD, the marked element, or the page's state."""
    h = F.col("html")
    ld = F.regexp_extract_all(h, F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), 1)
    offers = lambda t: F.coalesce(*(F.get_json_object(t, p) for p in ("$.offers.price", "$.offers[0].price", "$[0].offers.price", "$['@graph'][0].offers.price", "$['@graph'][1].offers.price")))
    of_ld = F.get(F.filter(F.transform(ld, lambda t: parse_int(F.regexp_replace(offers(t), r"[.,][0-9]{1,2}$", ""))), lambda p: p > 0), F.lit(0))
    number = lambda p: found(h, p).try_cast("double")
    state = found(h, r"\\?\"price\\?\"\s*:\s*([0-9]+)").try_cast("bigint")
    lat, lon = F.lit(None).cast("double"), F.lit(None).cast("double")
    if site.source == "krisha":
        price, lat, lon = state, number(r"\"map\"\s*:\s*\{[^}]*\"lat\"\s*:\s*([0-9.]+)"), number(r"\"map\"\s*:\s*\{[^}]*\"lon\"\s*:\s*([0-9.]+)")
    elif site.source == "olx":
        price, lat, lon = F.coalesce(of_ld, parse_int(visible(_first(h, site.fields["price"]))), state), number(r"\\?\"lat\\?\"\s*:\s*([0-9.]+)"), number(r"\\?\"lon\\?\"\s*:\s*([0-9.]+)")
    elif site.source == "kn":
        price = F.coalesce(of_ld, parse_int(visible(found(h, tag(has_class("kn-fs-26"))))))
        lat, lon = number(r"latitude-value=\"([0-9.]+)"), number(r"longitude-value=\"([0-9.]+)")
    else:
        own = F.try_parse_json(embedded_state("var data")(h))
        get = lambda k: F.regexp_replace(F.try_variant_get(own, f"$.{k}", "string"), "[^0-9.]", "").try_cast("double")
        price, lat, lon = get("price").cast("bigint"), get("la"), get("lo")
    return pages.select("page_id", "url", price.alias("price"), lat.alias("lat"), lon.alias("lon"), status(h, site).alias("status"))


def status(html: Column, site: Site) -> Column:
    """gone, archived, outdated or active; a source that tells by its price has gone where the page has none."""
    low = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "&nbsp;|\u00a0", " "), r"\s+", " "))
    out = F.when(F.lit(False), "")
    if site.gone:
        out = out.when(low.rlike(site.gone), "gone")
    if site.live:
        alive = F.lit(False)
        for mark in site.live:
            alive = alive | low.rlike(mark)
        out = out.when(~alive, "gone")
    if site.archived:
        out = out.when(low.rlike(site.archived), "archived")
    if site.outdated:
        out = out.when(low.rlike(site.outdated), "outdated")
    return out.otherwise("active")
