"""Raw pages to listing rows. What differs between sources is data: a `Site` names its patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clean_space, found, parse_float, parse_floor_pair, parse_int, parse_rooms
from ..operators.skew import join_counted, pinned
from .markup import Pick


@dataclass(frozen=True)
class Site:
    """marks, picks: selectors of cards and of the fields inside them (`markup`). For pages that are one line a card,
    card and fields are patterns instead, with the inside and the value as group 1. Of pictures: which to skip, how many at most, how their size is put to the large
    one, and what the gallery's have in their URL. Of detail pages: words that say that an advert is archived, outdated or
    gone, and marks of which a live one has one. Then how a card's floor, address and title are found."""

    source: str
    base: str
    card: str = ""
    fields: dict[str, str] = field(default_factory=dict)
    marks: tuple[str, ...] = ()
    picks: dict[str, tuple[Pick, ...]] = field(default_factory=dict)
    photo: str = r"(?i)<img[^>]+?(?:data-src|src)=[\"']([^\"']+)[\"']"
    markers: str = ""
    archived: str = "архив|неактуал|удалено"
    gone: str = ""
    outdated: str = ""
    live: tuple[str, ...] = ()
    skip: str = ""
    cap: int | None = None
    size: tuple[str, str] | None = None
    gallery: str = ""
    cut_address: str = ""
    floor_mark: str = ""
    street_of_title: bool = False
    title_of_fields: bool = False


def visible(html: Column) -> Column:
    """Text without scripts, styles and tags; the commonest entities are spelled out."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return clean_space(text)


def absolute(href: Column, base: str) -> Column:
    root = base.rstrip("/")
    return F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit(root), href)).when(href.rlike("^https?://"), href).otherwise(F.concat(F.lit(root + "/"), href))


def is_category_page(html: Column, markers: str) -> Column:
    """Title and heading, where there are any, hold a marker."""
    heads = clean_space(F.lower(F.concat_ws(" ", found(html, r"(?is)<title[^>]*>(.*?)</title>"), found(html, r"(?is)<h1[^>]*>(.*?)</h1>"))))
    return (heads == "") | heads.rlike(f"(?iU){markers}") if markers else F.lit(True)


def cards_of(pages: DataFrame, site: Site) -> DataFrame:
    """page_id, card_no, card: the cards of a source's category pages."""
    own = pages.filter(is_category_page(F.col("html"), site.markers))
    return own.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(site.card), 1)).alias("card_no", "card"))


def cards(pages: DataFrame, site: Site) -> DataFrame:
    """page_id, card_no and the listing fields of every card of a source's category pages."""
    each = cards_of(pages, site)
    get = lambda name: clean_space(visible(found(F.col("card"), site.fields[name]))) if name in site.fields else F.lit(None).cast("string")
    href = found(F.col("card"), site.fields["url"])
    text = F.coalesce(get("text"), visible(F.col("card")))
    floor = parse_floor_pair(text)
    photos = F.transform(F.regexp_extract_all("card", F.lit(site.photo), 1), lambda u: absolute(u, site.base))
    return each.select(
        "page_id", "card_no", F.lit(site.source).alias("source"), absolute(href, site.base).alias("url"), get("title").alias("title"),
        parse_int(get("price")).alias("price"), parse_rooms(get("rooms") if "rooms" in site.fields else get("title")).alias("rooms"),
        parse_float(get("area") if "area" in site.fields else found(text, r"(?U)([0-9]+(?:[.,][0-9]+)?)\s*м")).alias("area"),
        floor["floor"].alias("floor"), floor["total"].alias("total_floors"), get("address").alias("address"), clean_gallery(photos).alias("photos"), text.alias("description"),
    ).filter("url IS NOT NULL AND title IS NOT NULL")


def clean_gallery(photos: Column, cap: int | None = None) -> Column:
    """Without icons and inline data, in the large size, one of each picture whatever its extension."""
    kept = F.filter(photos, lambda u: ~F.lower(u).rlike(r"sprite|logo|icon|\.svg|^data:"))
    large = F.transform(kept, lambda u: F.regexp_replace(F.regexp_replace(u, r"-[0-9]+x[0-9]+(?=\.)", "-full"), r";s=[0-9x]+", ""))
    name = lambda u: F.regexp_replace(u, r"\.(?:jpe?g|png|webp)(?:\?.*)?$", "")
    unique = F.aggregate(large, F.array().cast("array<string>"), lambda acc, u: F.when(F.exists(acc, lambda a: name(a) == name(u)), acc).otherwise(F.concat(acc, F.array(u))))
    return F.slice(unique, 1, cap) if cap else unique


#: A quoted text, whole, or a bracket; all else is passed over in one step.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def balanced_json(text: str | None, marker: str) -> str | None:
    """The first {...} after a marker, by bracket depth outside quoted texts."""
    at = (text or "").find(marker)
    start = text.find("{", at) if at >= 0 else -1
    if start < 0:
        return None
    depth = 0
    for token in _TOKEN.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(token[0], 0)
        if not depth:
            return text[start : token.end()]
    return None


def embedded_state(marker: str):
    """An Arrow UDF that cuts a page's JSON state; nesting is beyond patterns."""

    @F.udf("string", useArrow=True)
    def cut(html):
        return balanced_json(html, marker)

    return cut


def unquoted_state(html: Column) -> Column:
    """The text inside JSON.parse('...'), un-escaped."""
    raw = found(html, r"JSON\.parse\('((?:[^'\\]|\\.)*)'\)")
    return F.replace(F.replace(F.replace(raw, F.lit('\\\\"'), F.lit('\\"')), F.lit("\\'"), F.lit("'")), F.lit("\\\\"), F.lit("\\"))


def _path(v: str, *paths: str, kind: str = "string") -> Column:
    return F.coalesce(*(F.expr(f"try_variant_get({v}, '$.{p}', '{kind}')") for p in paths))


def state_listings(pages: DataFrame, state: Column, source: str, lists: tuple[str, ...]) -> DataFrame:
    """Listings of the first of these array paths that a page's JSON state has. Numbers may be texts."""
    v = pages.select("page_id", F.try_parse_json(state).alias("v"))
    items = F.coalesce(*(F.expr(f"try_variant_get(v, '$.{p}', 'array<variant>')") for p in lists))
    each = v.select("page_id", F.posexplode(items).alias("card_no", "i"))
    number = lambda *p: F.regexp_replace(_path("i", *p), r"[^0-9.]", "").try_cast("double")
    rooms = number("rooms", "rooms_count")
    kind = _path("i", "type", "category")
    studio = F.lower(F.coalesce(kind, F.lit(""))).contains("studio")
    title = F.coalesce(_path("i", "title", "name"), F.concat_ws(", ", F.when(rooms > 0, F.concat(rooms.cast("int").cast("string"), F.lit("-комн."))).otherwise("студия"), _path("i", "address")))
    return each.select(
        "page_id", "card_no", F.lit(source).alias("source"), _path("i", "url", "link").alias("url"), _path("i", "id").alias("source_listing_id"), title.alias("title"),
        number("price", "price.value", "ads[0].price.value", "product.price").cast("bigint").alias("price"), F.when(studio, 0).otherwise(rooms.cast("int")).alias("rooms"),
        number("area", "square").alias("area"), number("floor").cast("int").alias("floor"), number("floors_total", "floors").cast("int").alias("total_floors"),
        _path("i", "address", "address_name").alias("address"), number("lat", "geometry.centroid.lat").alias("lat"), number("lon", "geometry.centroid.lon").alias("lon"),
        _path("i", "description").alias("description"), _path("i", "rental_period").alias("rental_period"), _path("i", "building_id").alias("building_id"), _path("i", "org_id").alias("provider_org_id"),
    )


#: Paths at which realty answers keep their adverts.
REALTY_LISTS = tuple(f"{a}.{b}" for a in ("result", "data", "response", "payload") for b in ("items", "adverts", "listings", "ads")) + ("items", "adverts")


def realty_json(pages: DataFrame, json_col: str = "html", source: str = "realty") -> DataFrame:
    """Nested answers: structured fields first, texts where they lack; wanted, daily and short-term adverts go."""
    from ..functions.texts import area_in_text, listing_type, rent_price, rooms_in_text

    rows = state_listings(pages, F.col(json_col), source, REALTY_LISTS)
    text = F.concat_ws("\n", "title", "description")
    full = rows.withColumns({"price": F.coalesce("price", rent_price(text)), "rooms": F.coalesce("rooms", rooms_in_text(text)), "area": F.coalesce("area", area_in_text(text)), "listing_type": listing_type(text)})
    return full.filter(~F.col("listing_type").isin("WANTED", "SHORT_TERM") & (F.coalesce(F.lower("rental_period"), F.lit("")) != "daily"))


MESSAGE = r"(?is)<div class=\"[^\"]*message_wrap[^\"]*\">(.*?)<!--/message-->"


def messages(pages: DataFrame, pattern: str = MESSAGE) -> DataFrame:
    """page_id, post, text, published, views, photos of each post; empty, wanted and daily ones go."""
    from ..functions.numbers import view_count
    from ..functions.texts import listing_type

    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("n", "m"))
    m = F.col("m")
    text = F.trim(F.regexp_replace(F.regexp_replace(found(m, r"(?is)<div class=\"[^\"]*message_text[^\"]*\"[^>]*>(.*?)</div>"), r"(?i)<br\s*/?>", "\n"), "<[^>]*>", ""))
    rows = each.select(
        "page_id", found(m, r"data-post=\"([^\"]+)\"").alias("post"), text.alias("text"), found(m, r"datetime=\"([^\"]+)\"").try_cast("timestamp").alias("published"),
        view_count(found(m, r"(?is)message_views\"[^>]*>([^<]+)<")).alias("views"), F.regexp_extract_all(m, F.lit(r"background-image:\s*url\(['\"]?([^'\")]+)"), 1).alias("photos"),
    )
    return rows.filter((F.coalesce(F.col("text"), F.lit("")) != "") & ~listing_type(F.col("text")).isin("WANTED", "SHORT_TERM"))


def base_url(url: Column) -> Column:
    return F.regexp_replace(F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/+$", "")


def detail_fields(pages: DataFrame) -> DataFrame:
    """page_id, url, price, lat, lon of detail pages: JSON-LD (object or graph), then attributes, then script state."""
    h = F.col("html")
    ld = found(h, r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>")
    price = F.coalesce(*(F.get_json_object(ld, p) for p in ("$.offers.price", "$[0].offers.price", "$['@graph'][0].offers.price")), found(h, r"itemprop=\"price\"[^>]*content=\"([^\"]+)\""), found(h, r"data-price=\"([^\"]+)\""), found(h, r"\"price\"\s*:\s*\"?([0-9][0-9 .]*)"))
    coord = lambda *names: F.coalesce(*(found(h, rf"\"{n}\"\s*:\s*\"?(-?[0-9]+\.[0-9]+)") for n in names), *(found(h, rf"data-{n}=\"(-?[0-9]+\.[0-9]+)") for n in names)).try_cast("double")
    return pages.select("page_id", "url", parse_int(F.regexp_replace(price, r"[.,][0-9]{1,2}$", "")).alias("price"), coord("lat", "latitude").alias("lat"), coord("lon", "lng", "longitude").alias("lon"))


def match_cards(details: DataFrame, card_rows: DataFrame) -> DataFrame:
    """Details with the price of a card where their own is missing: the card of the same base URL, else one whose base URL
    holds theirs or is held by it, up to a slash on the same host; of several, the longest common part, then the least price."""
    parents = lambda c: F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.size(F.split(c, "/")))), lambda k: F.array_join(F.slice(F.split(c, "/"), F.lit(1), k), "/"))
    c = pinned(card_rows.filter("url IS NOT NULL").groupBy(base_url(F.col("url")).alias("__card")).agg(F.min("price").alias("__card_price")).filter("__card_price IS NOT NULL"))
    asked = pinned(details.filter("url IS NOT NULL").select(base_url(F.col("url")).alias("__base")).distinct())
    # Very many URLs are under one parent, that of all listings of a site. What is asked of it is counted before it is joined, and
    # its cards are summed up before they are shuffled: all that its URL holds have as much in common with it.
    up = asked.select("__base", F.explode(F.array_distinct(parents(F.col("__base")))).alias("__card"))
    of = pinned(up.groupBy("__card").agg(F.count(F.lit(1)).alias("__n")).join(c, "__card", "left"))
    met = join_counted(up, of, "__card", "__n", F.col("__base")).filter("__card_price IS NOT NULL")
    own = F.col("__card") == F.col("__base")
    above = met.groupBy("__base").agg(F.max(F.when(own, F.col("__card_price"))).alias("__same"), F.max_by(F.when(~own, F.col("__card_price")), F.when(~own, F.length("__card"))).alias("__over"))
    below = c.select("__card_price", F.explode(F.filter(F.array_distinct(parents(F.col("__card"))), lambda x: x != F.col("__card"))).alias("__base")).groupBy("__base").agg(F.min("__card_price").alias("__under"))
    best = asked.join(above, "__base", "left").join(below, "__base", "left").select("__base", F.coalesce("__same", "__under", "__over").alias("__card_price"))
    joined = details.withColumn("__base", base_url(F.col("url"))).join(best, "__base", "left")
    return joined.withColumn("price", F.coalesce("price", "__card_price")).drop("__base", "__card_price")


def status_of(html: Column, site: Site) -> Column:
    """active, archived or gone."""
    low = F.lower(visible(html))
    out = F.when(low.rlike(f"(?U){site.archived}"), "archived")
    return (out.when(low.rlike(f"(?U){site.gone}"), "gone") if site.gone else out).otherwise("active")


def fresh_copy(pages: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """The newest copy of each URL, if it is young enough."""
    latest = pages.groupBy("url").agg(F.max_by(F.struct("html", "fetched_at"), "fetched_at").alias("p"))
    return latest.select("url", "p.html", "p.fetched_at").filter(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds("fetched_at") <= seconds)
