"""Filters, orders and limits of searches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Search:
    """What a search asks for; None and empty mean anything."""

    rooms: tuple[int, ...] = ()
    price: tuple[int | None, int | None] = (None, None)
    area: tuple[float | None, float | None] = (None, None)
    floor: tuple[int | None, int | None] = (None, None)
    district: str = ""
    query: str = ""
    sources: tuple[str, ...] = ()
    furnished_only: bool = False
    photos_only: bool = False
    limit: int = 0
    query_fields: tuple[str, ...] = field(default=("title", "description"))

    def __post_init__(self) -> None:
        if any(not 0 <= r <= 6 for r in self.rooms):
            raise ValueError("rooms are from 0 to 6")


def _bounds(name: str, low, high, keep: bool) -> list[Column]:
    c = F.col(name)
    tests = [c >= low] * (low is not None) + [c <= high] * (high is not None)
    return [c.isNull() | t if keep else t for t in tests]


def _text(fields) -> Column:
    return F.lower(F.concat_ws(" ", *fields))


def search(df: DataFrame, s: Search, nulls: str = "keep") -> DataFrame:
    """nulls="keep": a missing value passes (collecting); "drop": it fails where a bound is set (viewing)."""
    if nulls not in ("keep", "drop"):
        raise ValueError("nulls is keep or drop")
    keep = nulls == "keep"
    tests = [*_bounds("price", *s.price, keep), *_bounds("area", *s.area, keep), *_bounds("floor", *s.floor, keep)]
    if s.rooms:
        many = F.col("rooms").isin(*s.rooms) | (F.lit(4 in s.rooms) & (F.col("rooms") >= 4))
        tests.append(F.col("rooms").isNull() | many if keep else many)
    if s.district:
        tests.append(F.coalesce(F.col("address"), F.lit("")).isin("") | F.lower("address").contains(s.district.lower()) if keep else in_district(s.district))
    if s.query:
        tests.append(_text([F.col(c) for c in (s.query_fields if keep else (*s.query_fields, "address"))]).contains(s.query.lower()))
    if s.sources:
        tests.append(F.col("source").isin(*s.sources))
    if s.photos_only:
        tests.append(F.size("photos") > 0)
    if s.furnished_only:
        tests.append(~_text([F.col("title"), F.col("description")]).rlike("без мебели|мебели нет|unfurnished"))
    for t in tests:
        df = df.filter(t)
    return df.limit(s.limit) if s.limit else df


def in_district(name: str) -> Column:
    """The assigned district where there is one, else the name as a word of address or title."""
    import re

    word = _text([F.col("address"), F.col("title")]).rlike(rf"(?U)\b{re.escape(name.lower())}\b")
    return F.when(F.col("district").isNotNull(), F.lower("district") == name.lower()).otherwise(word)


def has_substance(df: DataFrame) -> DataFrame:
    """Rows with a price, rooms or an area."""
    return df.filter(F.coalesce(F.col("price").cast("double"), F.col("rooms").cast("double"), F.col("area").cast("double")).isNotNull())


def in_city(lat: Column, lon: Column, box: tuple[float, float, float, float] = (43.0, 43.5, 76.6, 77.2)) -> Column:
    """Struct (lat, lon), both null outside the box."""
    inside = lat.between(box[0], box[1]) & lon.between(box[2], box[3])
    return F.struct(F.when(inside, lat).alias("lat"), F.when(inside, lon).alias("lon"))


def by_price(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("price").asc_nulls_last(), "url")


def by_date(df: DataFrame, newest_first: bool = True) -> DataFrame:
    """Updated else published; undated rows last either way."""
    on = F.coalesce("date_updated", "date_published")
    return df.orderBy(on.desc_nulls_last() if newest_first else on.asc_nulls_last(), "url")


def by_score(df: DataFrame, best_first: bool = True) -> DataFrame:
    p = F.coalesce("prob", F.lit(-1.0))
    return df.orderBy(p.desc() if best_first else p.asc(), "url")


def by_rating(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("rating").desc_nulls_last(), F.col("updated_at").desc_nulls_last())


def fair_mix(df: DataFrame, cap: int) -> DataFrame:
    """Round-robin over sources, the best of each first. Only `cap` rows of a source can be among `cap`."""
    w = Window.partitionBy("source").orderBy(F.coalesce("quality_score", F.lit(0)).desc(), F.col("price").asc_nulls_last(), "url")
    return df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= cap).orderBy("turn", "source").limit(cap)


def recheck_candidates(df: DataFrame, as_of: Column, hours: int = 6, n: int = 30) -> DataFrame:
    """Rows to check again: never checked first, then the longest unchecked."""
    due = F.col("checked_at").isNull() | (F.col("checked_at") <= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    return df.filter(due).orderBy(F.col("checked_at").asc_nulls_first(), "source", "url").limit(n)


def by_update(df: DataFrame, key: str, newest_first: bool = True) -> DataFrame:
    """Dimension rows by updated_at, undated ones last; equally late ones by key."""
    on = F.col("updated_at")
    return df.orderBy(on.desc_nulls_last() if newest_first else on.asc_nulls_last(), key)


def good_share(df: DataFrame, threshold: float) -> DataFrame:
    """One row: total, good (a probability of threshold + 0.1 or more) and their share, 0 of none."""
    good = F.count_if(F.col("prob") >= threshold + 0.1)
    return df.agg(F.count(F.lit(1)).alias("total"), good.alias("good"), F.coalesce(F.try_divide(good, F.count(F.lit(1))), F.lit(0.0)).alias("share"))


def top_deals(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("prob").desc(), "url").limit(n)


def newest(df: DataFrame, n: int, open_only: bool = True) -> DataFrame:
    return (df.filter(~F.col("closed")) if open_only else df).orderBy(F.col("id").desc()).limit(n)


def organizations_matching(organizations: DataFrame, text: str, fields: tuple[str, ...] = ("name", "address")) -> DataFrame:
    """Rows in which a field contains the text, without regard to case."""
    test = F.lit(False)
    for c in fields:
        test = test | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return organizations.filter(test)
