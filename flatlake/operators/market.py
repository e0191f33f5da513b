"""Market reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phones import normalize_phone
from .skew import join_counted, quantile_by, quantile_sets, same


def median_by(df: DataFrame, keys: list[str], value: Column | str = "price", least: int = 1, name: str = "median_price") -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    own = quantile_by(df.withColumn("__value", v), keys, "__value", 0.5).withColumnRenamed("quantile", name)
    return own.filter(F.col("n") >= least)


def rent_per_area(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median price of a square metre, and how many rows have one, of each group."""
    rows = df.select(*keys, F.try_divide(F.col("price"), F.col("area")).alias("__per"))
    means = rows.groupBy(*keys).agg(F.avg("__per").alias("mean_per_m2"), F.count("__per").alias("n"))
    return _with_median(means, quantile_by(rows, keys, "__per", 0.5), keys, "median_per_m2").select(*keys, "mean_per_m2", "median_per_m2", "n")


def _with_median(groups: DataFrame, medians: DataFrame, keys: list[str], name: str) -> DataFrame:
    """groups, a row each, with the median of each; null keys are alike."""
    own = medians.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("quantile").alias(name))
    return groups.join(own, same({k: F.col(k) for k in keys}, {k: F.col(f"__k_{k}") for k in keys}), "left").drop(*(f"__k_{k}" for k in keys))


def by_building(df: DataFrame, key: str = "building_id", least: int = 1) -> DataFrame:
    """Of each building with `least` priced listings or more: how many, the median rent, and the mean and median of a square
    metre's. Listings without a building are left out."""
    own = df.filter(F.col(key).isNotNull())
    rents = median_by(own, [key], least=least, name="median_rent")
    return rents.join(rent_per_area(own, [key]).drop("n"), key).select(key, "n", "median_rent", "mean_per_m2", "median_per_m2")


def days_on_market(observations: DataFrame, key: str = "listing_key") -> DataFrame:
    return observations.groupBy(key).agg(F.datediff(F.max("seen_at"), F.min("seen_at")).cast("long").alias("days"), F.count(F.lit(1)).alias("n"))


def with_organizations(listings: DataFrame, organizations: DataFrame) -> DataFrame:
    """A row for each listing and organization (org_id, name and, if they are listed, phones, an array) that it belongs to: by
    its provider_org_id, or by a phone that is one of theirs however either writes it; one row where both say so. A number
    that a large share of the listings has is handed to all tasks, and so is an organization with as many."""
    rows, own = listings.withColumn("__id", F.col("provider_org_id")), F.struct("org_id", "name")
    by_id = organizations.filter("org_id IS NOT NULL").groupBy(F.col("org_id").alias("__id")).agg(F.array_distinct(F.collect_list(own)).alias("__orgs"))
    keys = [("__id", by_id, "__of_id")]
    if "phones" in organizations.columns and "phone" in listings.columns:
        rows = rows.withColumn("__phone", F.nullif(normalize_phone(F.col("phone")), F.lit("")))
        each = organizations.filter("org_id IS NOT NULL").select("org_id", "name", F.explode("phones").alias("__raw")).withColumn("__phone", F.nullif(normalize_phone(F.col("__raw")), F.lit("")))
        keys.append(("__phone", each.filter("__phone IS NOT NULL").groupBy("__phone").agg(F.array_distinct(F.collect_list(own)).alias("__orgs")), "__of_phone"))
    for key, table, name in keys:
        counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        rows = join_counted(rows, table.join(counts, key), key, "__n", F.xxhash64(*listings.columns)).drop("__n").withColumnRenamed("__orgs", name)
    none = F.array().cast("array<struct<org_id: {}, name: string>>".format(dict(organizations.dtypes)["org_id"]))
    found = F.array_distinct(F.concat(*(F.coalesce(F.col(name), none) for _, _, name in keys)))
    kept = [c for c in listings.columns if c not in ("org_id", "name")]
    return rows.withColumn("__org", F.explode(found)).select(*kept, "__org.org_id", "__org.name")


def agency_portfolio(listings: DataFrame, organizations: DataFrame) -> DataFrame:
    """Per organization: listings, median price, districts, kinds, mean area, and the share of its dated listings that were
    updated after they were published (null where none is dated, or without date_updated). Organizations with the same
    numbers, none of which a listing names by id, have the same listings: these are summed up once for all of them."""
    orgs, members = _alike_organizations(listings, organizations)
    joined = with_organizations(listings, orgs)
    dated = "date_updated" in listings.columns
    updated = F.avg((F.coalesce("date_updated", "date_published") > F.col("date_published")).cast("int")) if dated else F.lit(None).cast("double")
    groups = joined.groupBy("org_id", "name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("district").alias("n_districts"),
        F.array_join(F.array_sort(F.collect_set(F.col("rooms").cast("string"))), ",").alias("kinds"), F.avg("area").alias("mean_area"), updated.alias("update_rate"),
    )
    found = _with_median(groups, quantile_by(joined, ["org_id", "name"], "price", 0.5), ["org_id", "name"], "median_price")
    if members is not None:
        own = members.select(F.col("first.org_id").alias("__id"), F.col("first.name").alias("__name"), "org_id", "name")
        found = own.join(found.withColumnsRenamed({"org_id": "__of", "name": "__called"}), same({"a": F.col("__id"), "b": F.col("__name")}, {"a": F.col("__of"), "b": F.col("__called")}))
    return found.select("org_id", "name", "n", "median_price", "n_districts", "kinds", "mean_area", "update_rate")


def _alike_organizations(listings: DataFrame, organizations: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One organization of those that have the same numbers and no listing by id, with these numbers; and (first, org_id, name):
    for each organization, that one. An organization that listings name by its id stands for itself, as all with its id do."""
    if "phones" not in organizations.columns or "phone" not in listings.columns:
        return organizations, None
    known = organizations.filter("org_id IS NOT NULL").select("org_id", "name", F.explode_outer("phones").alias("__raw"))
    numbers = F.array_sort(F.collect_set(F.nullif(normalize_phone(F.col("__raw")), F.lit(""))))
    each = known.groupBy("org_id", "name").agg(numbers.alias("phones"))
    named = listings.select(F.col("provider_org_id").alias("__by")).filter("__by IS NOT NULL").distinct()
    own = F.struct("org_id", "name")
    held = each.join(named, F.col("org_id") == F.col("__by"), "left").withColumn("__own", F.when(F.col("__by").isNotNull(), own))
    held = held.filter((F.size("phones") > 0) | F.col("__own").isNotNull())  # the others have no listing
    sets = held.groupBy("phones", "__own").agg(F.min(own).alias("first"))
    of = sets.select("first", F.col("phones").alias("__phones"), F.col("__own").alias("__of"))
    members = held.join(of, same({"p": F.col("phones"), "o": F.col("__own")}, {"p": F.col("__phones"), "o": F.col("__of")}))
    return sets.select("first.org_id", "first.name", "phones"), members.select("first", "org_id", "name")


def market_rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, median_price and level for each group of keys and of each shorter list of them, down to all rows. level has
    a bit for each key that is summed up, as grouping_id() has."""
    sets = [keys[:k] for k in range(len(keys), -1, -1)]
    found = quantile_sets(df, sets, "price", 0.5)
    bits = F.element_at(F.array(*(F.lit(2 ** (len(keys) - len(own)) - 1).cast("long") for own in sets)), F.col("level") + 1)
    return found.select(*keys, F.col("rows").alias("n"), F.col("quantile").alias("median_price"), bits.alias("level"))


def peer_ratio(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the median price of the rows alike in keys, nulls being alike, and its own price as a share of it."""
    peers = quantile_sets(df, [keys], "price", 0.5).select(F.struct(*keys).alias("__key"), F.col("quantile").alias("peer_median"), "rows")
    met = join_counted(df.withColumn("__key", F.struct(*keys)), peers, "__key", "rows", F.xxhash64(*df.columns))
    return met.drop("__key", "rows").withColumn("ratio", F.try_divide(F.col("price"), F.col("peer_median")))


def reposts(observations: DataFrame, gap_days: int) -> DataFrame:
    """fingerprint, url, first_seen, last_seen: urls that bring back a fingerprint last seen over gap_days before."""
    w = Window.partitionBy("fingerprint").orderBy("first_seen", "url")
    back = observations.filter("fingerprint <> ''").withColumn("prev_url", F.lag("url").over(w)).withColumn("prev_seen", F.max("last_seen").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return back.filter((F.col("prev_url") != F.col("url")) & (F.datediff("first_seen", "prev_seen") > gap_days)).select("fingerprint", "url", "prev_url", F.datediff("first_seen", "prev_seen").alias("gap"))
