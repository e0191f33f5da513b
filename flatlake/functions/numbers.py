"""Numbers, keys and labels out of listing fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return blank_to_null(F.regexp_extract(x, pattern, group))


def parse_int(x: Column) -> Column:
    """All digits of a text joined: "150 000 T" is 150000."""
    return F.regexp_replace(x, "[^0-9]", "").try_cast("bigint")


def parse_float(x: Column) -> Column:
    """The first number, with comma or point."""
    return F.replace(F.regexp_extract(x, r"[0-9]+(?:[.,][0-9]+)?", 0), F.lit(","), F.lit(".")).try_cast("double")


def parse_rooms(x: Column) -> Column:
    """"3 комн", "3-к", a studio (0), or the digits."""
    low = F.lower(x)
    return F.coalesce(
        found(low, r"([0-9]+)\s*комн").try_cast("int"),
        found(low, r"([0-9]+)\s*-?\s*к").try_cast("int"),
        F.when(low.contains("студ"), 0),
        parse_int(x).try_cast("int"),
    )


def parse_floor_pair(x: Column) -> Column:
    """Struct (floor, total) from "5/9" or "5 эт"; numbers beyond 60 are house numbers."""
    a, b = (found(x, r"([0-9]+)\s*[/\\]\s*([0-9]+)", g).try_cast("int") for g in (1, 2))
    alone = found(F.lower(x), r"([0-9]+)\s*эт").try_cast("int")
    pair = x.rlike(r"[0-9]+\s*[/\\]\s*[0-9]+")
    fits = a.between(1, 60) & b.between(1, 60)
    return F.struct(
        F.when(pair, F.when(fits, a)).otherwise(F.when(alone.between(1, 60), alone)).alias("floor"),
        F.when(pair & fits, b).alias("total"),
    )


def lenient_double(x: Column) -> Column:
    """A number from CSV: blanks out, comma to point, finite only."""
    n = F.replace(F.regexp_replace(F.trim(x), r"[\s ]", ""), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def scaled(number: Column, unit: Column) -> Column:
    """Thousands and millions."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    return F.when(u.rlike("^(тыс|мың)"), number * 1000).when(u.rlike("^(млн|миллион)"), number * 1_000_000).when(u.isin("к", "k"), number * 1000).otherwise(number)


def view_count(x: Column) -> Column:
    """"484", "1.2K", "12K"."""
    n = F.replace(F.regexp_extract(x, r"[0-9]+(?:[.,][0-9]+)?", 0), F.lit(","), F.lit(".")).try_cast("decimal(18,3)")
    return F.when(F.upper(x).rlike("[KК]"), n * 1000).otherwise(n).cast("bigint")


def grouped(x: Column) -> Column:
    """1234567 as "1 234 567"."""
    return F.replace(F.format_number(x, 0), F.lit(","), F.lit(" "))


def converted(price: Column, rate: Column, decimals: int = 0) -> Column:
    """Half-even, as money is rounded here throughout."""
    return F.bround(price * rate, decimals)


def price_text(price: Column, rub: Column, usd: Column) -> Column:
    """"250 000 ₸ (41 250 ₽, 515 $)", a dash without a price."""
    return F.when(price.isNull(), F.lit("—")).otherwise(F.concat(grouped(price), F.lit(" ₸ ("), grouped(converted(price, rub)), F.lit(" ₽, "), grouped(converted(price, usd)), F.lit(" $)")))


def listing_key(source: Column, url: Column, title: Column) -> Column:
    """16 hex digits of the three parts' SHA-256."""
    joined = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (source, url, title)))
    return F.substring(F.sha2(joined, 256), 1, 16)


def row_key(source: Column, url: Column) -> Column:
    return F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(url, F.lit("")))


def ad_id(html: Column, url: Column) -> Column:
    """The numeric id of an advert: promote link, sku, offer or ad id, data attribute, then the URL."""
    tries = (r"promote[^\"']*?([0-9]{6,})", r'"sku"\s*:\s*"?([0-9]{6,})', r'"(?:offerId|adId)"\s*:\s*"?([0-9]{6,})', r'data-(?:id|ad-id)="([0-9]{6,})')
    return F.coalesce(*(found(html, p) for p in tries), found(url, r"([0-9]{6,})"))


def distance_text(metres: Column) -> Column:
    """Tens of metres under a kilometre, else kilometres with a comma."""
    tens = (F.bround(metres / 10, 0) * 10).cast("int")
    return F.when(metres < 1000, F.concat(tens.cast("string"), F.lit(" м"))).otherwise(F.concat(F.replace(F.format_number(metres / 1000, 1), F.lit("."), F.lit(",")), F.lit(" км")))


def room_label(rooms: Column) -> Column:
    return F.when(rooms == 0, "студия").when(rooms.isNotNull(), F.concat(rooms.cast("string"), F.lit("-комн.")))


def clean_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
