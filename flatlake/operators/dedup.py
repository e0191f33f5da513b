"""Deduplication of listings, and clusters of contacts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import HELD, MANY, join_counted, pinned


def fingerprint(location: Column, rooms: Column, area: Column, floor: Column, price: Column, building: Column | None = None) -> Column:
    """Location, rooms, whole square metres, floor and a 20 000 price band; empty without location and price."""
    loc = F.lower(F.trim(F.coalesce(*([F.nullif(building, F.lit(""))] if building is not None else []), location, F.lit(""))))
    band = F.when(price != 0, F.floor(price / 20_000) * 20_000)
    parts = [F.when(loc == "", "_").otherwise(loc), *(F.coalesce(x.cast("string"), F.lit("_")) for x in (rooms, F.floor(area), floor, band))]
    return F.when((loc == "") & price.isNull(), "").otherwise(F.concat_ws("|", *parts))


def first_of(df: DataFrame, keys: list[str], order: list[Column], keep_keyless: bool = True) -> DataFrame:
    """The first row, by order, of each key. Rows whose keys are all empty are kept as they are, or dropped."""
    empty = F.lit(True)
    for k in keys:
        empty = empty & (F.coalesce(F.col(k), F.lit("")) == "")
    w = Window.partitionBy(*keys).orderBy(*order)
    keyed = df.filter(~empty).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return keyed.unionByName(df.filter(empty)) if keep_keyless else keyed


def collapse(df: DataFrame, group: str = "duplicate_group_id", url: str = "url") -> DataFrame:
    """One master per group: the earliest dated, then the best. It gets sources_count, and 5 points of quality
    (to 100) where several rows were one. Rows without a group stand by their URL."""
    key = F.when(F.coalesce(F.col(group), F.lit("")) == "", F.concat(F.lit("__u"), F.coalesce(F.col(url), F.lit("")))).otherwise(F.col(group))
    own = df.withColumn("__key", key)
    order = F.struct(F.coalesce(F.col("date_published").cast("string"), F.lit("9999")), -F.coalesce("quality_score", F.lit(0)), F.coalesce(F.col(url), F.lit("")))
    best = own.groupBy("__key").agg(F.min_by(F.struct(*df.columns), order).alias("m"), F.count(F.lit(1)).cast("int").alias("sources_count"))
    rows = best.select(*(F.col(f"m.{c}").alias(c) for c in df.columns if c != "sources_count"), "sources_count")
    return rows.withColumn("quality_score", F.when(F.col("sources_count") >= 2, F.least(F.lit(100), F.col("quality_score") + 5)).otherwise(F.col("quality_score")))


def cheapest(df: DataFrame) -> DataFrame:
    """For training: of rows alike in rooms, whole area and district, the cheapest; rows that lack one stay."""
    area = F.bround("area", 0)
    whole = F.col("rooms").isNotNull() & area.isNotNull() & F.col("district").isNotNull()
    best = df.filter(whole).groupBy("rooms", area, "district").agg(F.min_by(F.struct(*df.columns), F.struct("price", "url")).alias("m"), F.count(F.lit(1)).cast("int").alias("sources_count"))
    some = best.select(*(F.col(f"m.`{c}`").alias(c) for c in df.columns if c != "sources_count"), "sources_count")
    return some.unionByName(df.filter(~whole).withColumn("sources_count", F.lit(1)).select(some.columns))


def banded(df: DataFrame, metres2: float, share: float, held: int = HELD, many: int = MANY) -> DataFrame:
    """df with cell, a struct of location, rooms and area band, and, where `many` listings or 1 / held of all share these, a
    price band; and heavy, whether that is so. Pairs within the tolerances are in one cell or in neighbouring bands."""
    own = df.withColumn("__place", F.struct("location", "rooms", F.floor(F.col("area") / metres2).alias("area")))
    counts = pinned(own.groupBy("__place").agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    heavy = counts.filter((F.col("__n") >= many) & (F.col("__n") * held >= total)).select("__place", F.lit(True).alias("__heavy"))  # `held` rows at most
    return own.join(F.broadcast(heavy), "__place", "left").withColumnRenamed("__place", "cell").withColumn("heavy", F.coalesce("__heavy", F.lit(False))).drop("__heavy")


def near_listings(df: DataFrame, metres2: float = 2.0, share: float = 0.05, held: int = HELD, many: int = MANY) -> DataFrame:
    """(a, b): urls of listings of one location and room count whose areas and prices are within the tolerances. Areas are
    banded so that a pair shares a band or has neighbouring ones; so are prices where very many listings share a location,
    room count and area band. share is under 1."""
    own = df.filter("location <> '' AND area IS NOT NULL AND price > 0").select("url", "location", "rooms", "area", "price")
    cells = pinned(banded(own, metres2, share, held, many).withColumn("band", F.floor(F.log("price") / (-math.log(1 - share) * (1 + 1e-9)))))
    right = cells.select("*", F.when(F.col("heavy"), F.col("band")).alias("at")).alias("r")
    beside = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.col("cell").withField("area", F.col("cell.area") + d))).alias("cell")
    own_heavy = cells.filter("heavy").select("cell").distinct().withColumn("heavy", F.lit(True))  # `held` rows at most
    left = cells.select("url", "area", "price", "band", beside).join(F.broadcast(own_heavy), "cell", "left")
    near_bands = F.when(F.col("heavy"), F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.col("band") + d)).otherwise(F.array(F.lit(None).cast("long")))
    left = left.withColumn("at", F.explode(near_bands)).alias("l")
    near = (F.abs(F.col("l.area") - F.col("r.area")) <= metres2) & (F.abs(F.col("l.price") - F.col("r.price")) <= share * F.greatest("l.price", "r.price"))
    on = (F.col("l.cell") == F.col("r.cell")) & F.col("l.at").eqNullSafe(F.col("r.at"))
    pairs = lambda x, y: x.join(y, on & near & (F.col("l.url") < F.col("r.url"))).select(F.col("l.url").alias("a"), F.col("r.url").alias("b"))
    # Two rows meet once, so that a pair of URLs comes more often only if one of them has several rows. Only such pairs are shuffled again.
    again = pinned(cells.groupBy("url").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col("url").alias("__again")))
    if again.isEmpty():
        return pairs(left, right)
    some = lambda x, name, how: x.join(again, F.col(f"{name}.url") == F.col("__again"), how).alias(name)
    once = some(left, "l", "left_anti")
    repeated = pairs(some(left, "l", "left_semi"), right).unionByName(pairs(once, some(right, "r", "left_semi"))).distinct()
    return pairs(once, some(right, "r", "left_anti")).unionByName(repeated)


def contact_clusters(df: DataFrame, url: str = "url", marks: tuple[str, ...] = ("phone", "duplicate_group_id"), most: int = 40) -> DataFrame:
    """(url, cluster): listings joined by equal non-empty phones or fingerprints, directly or in steps; cluster is
    the least url. Labels spread by marks, both ways in one round; rounds are checkpointed until nothing changes."""
    links = None
    for m in marks:
        part = df.filter(F.coalesce(F.col(m), F.lit("")) != "").select(F.col(url).alias("url"), F.concat(F.lit(f"{m}:"), F.col(m)).alias("mark"))
        links = part if links is None else links.unionByName(part)
    links = pinned(links.filter("url IS NOT NULL").distinct())
    total = links.count()
    now = pinned(df.filter(F.col(url).isNotNull()).select(F.col(url).alias("url"), F.col(url).alias("cluster")).distinct())
    for _ in range(most):
        of_mark = links.join(now, "url").groupBy("mark").agg(F.min("cluster").alias("cluster"), F.count(F.lit(1)).alias("n"))
        seen = join_counted(links, of_mark, "mark", "n", F.col("url"), total).groupBy("url").agg(F.min("cluster").alias("low"))
        step = now.join(seen, "url", "left").select("url", F.least("cluster", F.coalesce("low", "cluster")).alias("cluster"))
        # A label's own label is at least as low: two steps at once.
        up = step.select(F.col("url").alias("cluster"), F.col("cluster").alias("up"))
        new = step.join(up, "cluster", "left").select("url", F.coalesce("up", "cluster").alias("cluster"))
        new = pinned(new)
        changed = new.join(now.withColumnRenamed("cluster", "was"), "url").filter("cluster <> was").isEmpty()
        now = new
        if changed:
            return now
    raise RuntimeError(f"clusters have not settled after {most} rounds")
