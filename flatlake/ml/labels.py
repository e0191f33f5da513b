"""Good-price labels and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags
from ..operators.dedup import first_of
from ..operators.skew import quantile_by
from ..operators.stats import exclusive_quantile, group_median

#: The base columns of a feature row, in their order.
BASE = [
    "price", "currency", "rooms", "area", "floor", "total_floors", "price_per_m2", "price_per_room", "floor_ratio", "is_first_floor", "is_last_floor", "district",
    "microdistrict", "residential_complex", "deal_type", "listing_type", "rental_period", "deposit", "commission_percent", "utilities", "owner_probability", "views",
    "quality_score", "sources_count", "n_photos", "has_photo", "source", "desc_length", "desc_words", "furnished", "pets_allowed", "children_allowed", "available_from",
]
#: Columns from which a label could be read off; never features.
LEAKS = {"price", "price_per_m2", "price_per_room", "log_price", "source_price_ratio"}


def ratios(df: DataFrame) -> DataFrame:
    """Price per square metre and room, floor ratio and flags, photo and text counts; no value without a divisor."""
    words = F.filter(F.split(F.coalesce(F.col("description"), F.lit("")), r"(?U)\s+"), lambda w: w != "")
    photos = F.size(F.filter(F.coalesce(F.col("photos"), F.array().cast("array<string>")), lambda u: u.startswith("http")))
    flag = lambda t: F.coalesce(t, F.lit(False)).cast("int")
    return df.withColumns({
        "price_per_m2": F.bround(F.try_divide(F.nullif("price", F.lit(0)), F.nullif("area", F.lit(0.0))), 1),
        "price_per_room": F.bround(F.try_divide(F.nullif("price", F.lit(0)), F.nullif("rooms", F.lit(0))), 1),
        "floor_ratio": F.bround(F.try_divide(F.nullif("floor", F.lit(0)), F.nullif("total_floors", F.lit(0))), 2),
        "is_first_floor": flag(F.col("floor") == 1), "is_last_floor": flag((F.col("floor") == F.col("total_floors")) & (F.col("floor") != 0)),
        "n_photos": photos, "has_photo": flag(photos > 0), "desc_length": F.length(F.coalesce("description", F.lit(""))), "desc_words": F.size(words),
    })


def feature_rows(df: DataFrame) -> DataFrame:
    """One row of features per listing: base columns, tags, overrides by known fields, and keys."""
    own = ratios(df)
    if "district_name" in own.columns:
        own = own.withColumn("district", F.coalesce("district_name", "district"))
    tagged = tags.with_tags(own)
    for c in BASE:
        if c not in tagged.columns:
            tagged = tagged.withColumn(c, F.lit(None).cast("string"))
    one = lambda test, c: F.when(F.coalesce(test, F.lit(False)), 1).otherwise(F.col(c))
    listed = tagged.withColumn("tag_list", tags.tag_list(tags.NAMES))
    furnished = F.col("furnished").try_cast("boolean")
    extra = lambda c, word: F.when(F.col(c).try_cast("boolean"), F.lit(word))
    full = listed.withColumns({
        "tag_list": F.concat_ws("|", F.nullif("tag_list", F.lit("")), extra("pets_allowed", "pets_ok"), extra("children_allowed", "children_ok")),
        "tag_fully_furnished": one(furnished, "tag_fully_furnished"), "furniture_level": F.coalesce("furniture_level", F.when(furnished, "full")),
        "tag_daily": one((F.col("listing_type") == "SHORT_TERM") | (F.col("deal_type") == "short_term"), "tag_daily"), "tag_long_term": one(F.col("deal_type") == "long_term", "tag_long_term"),
        "row_key": F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("url", F.lit(""))),
    })
    level = F.create_map(*(x for k, v in tags.FURNITURE_LEVEL.items() for x in (F.lit(k), F.lit(v))))
    return full.withColumn("furniture_grade", level[F.col("furniture_level")]).select(*BASE, "year_built", "ceiling_height", "renovation_grade", "furniture_level", "furniture_grade", "building_type", "bathroom_type", *tags.NAMES, "tag_list", "row_key", "url", "title")


def training_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """Priced rows, the first by order of each (source, url), whatever the source's case and the blanks around either; rows
    that have neither are all kept."""
    plain = {"__source": F.lower(F.trim(F.coalesce("source", F.lit("")))), "__url": F.trim(F.coalesce("url", F.lit("")))}
    priced = df.filter(F.trim(F.coalesce(F.col("price").cast("string"), F.lit(""))) != "").withColumns(plain)
    return first_of(priced, ["__source", "__url"], order).drop("__source", "__url")


def area_bucket(area: Column) -> Column:
    """Bins of 15 square metres, "?" without an area."""
    return F.coalesce(F.floor((area - 1) / 15).cast("string"), F.lit("?"))


def median_label(df: DataFrame, least: int = 3) -> DataFrame:
    """good is 1 where the price is at or under the median of its rooms, district and area bin."""
    own = df.filter("price IS NOT NULL").withColumn("bucket", area_bucket(F.col("area")))
    return group_median(own, ["rooms", "district", "bucket"], "price", least, "threshold").withColumn("good", (F.col("price") <= F.col("threshold")).cast("int"))


def quantile_label(df: DataFrame, q: float = 0.30, least: int = 10, compat: str = "") -> DataFrame:
    """good is 1 where price per area is in the lowest q of its rooms and area bin, or, without an area, the price
    of its rooms and district. Groups under `least` use the quantile of all; with compat="strict", groups under 20
    have the threshold 0, as the first release of the labels had it."""
    strict = compat == "strict"
    own = df.filter("price IS NOT NULL").withColumns({"bucket": area_bucket(F.col("area")), "__per": F.try_divide(F.col("price").cast("double"), F.nullif("area", F.lit(0.0)))})
    by_area = F.col("__per").isNotNull()
    value = F.when(by_area, F.col("__per")).otherwise(F.col("price").cast("double"))
    key = F.when(by_area, F.concat_ws("|", F.lit("m2"), F.coalesce(F.col("rooms").cast("string"), F.lit("?")), "bucket")).otherwise(F.concat_ws("|", F.lit("all"), F.coalesce(F.col("rooms").cast("string"), F.lit("?")), F.coalesce("district", F.lit("?"))))
    rows = own.withColumns({"__key": key, "__value": value, "__kind": by_area.cast("int")})
    groups = exclusive_quantile(rows, ["__key"], "__value", q, 20 if strict else least).select("__key", F.col("quantile").alias("__own"))
    of_all = exclusive_quantile(rows, ["__kind"], "__value", q, 1).select("__kind", F.col("quantile").alias("__all"))
    joined = rows.join(groups, "__key", "left").join(F.broadcast(of_all), "__kind")  # two rows
    threshold = F.coalesce("__own", F.lit(0.0) if strict else F.col("__all"))
    return joined.withColumn("threshold", threshold).withColumn("good", (F.col("__value") <= F.col("threshold")).cast("int")).drop("__key", "__value", "__kind", "__own", "__all", "__per")


def extra_features(df: DataFrame, amenities: list[str]) -> DataFrame:
    """Ratio to the source's median price, rooms times area, amenity count, log price."""
    medians = quantile_by(df, ["source"], "price", 0.5).select("source", F.col("quantile").alias("__m"))
    count = sum((F.coalesce(F.col(a), F.lit(0)) for a in amenities), F.lit(0))
    return df.join(medians, "source", "left").withColumns({"source_price_ratio": F.try_divide(F.col("price"), F.col("__m")), "rooms_area": F.col("rooms") * F.col("area"), "amenities": count, "log_price": F.ln(F.nullif("price", F.lit(0)))}).drop("__m")


def guard(features: list[str]) -> list[str]:
    """Raises if a feature tells the label."""
    if bad := sorted(LEAKS & set(features)):
        raise ValueError(f"features that tell the price: {', '.join(bad)}")
    return features
