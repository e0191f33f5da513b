"""Price histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extremes(history: DataFrame, key: str = "listing_key") -> DataFrame:
    """First and last price of each key, their difference, per cent (one decimal, half-even) and direction."""
    known = history.filter("price IS NOT NULL")
    at = F.struct("checked_at", "seq") if "seq" in history.columns else F.col("checked_at")
    own = known.groupBy(key).agg(F.min_by("price", at).alias("first_price"), F.max_by("price", at).alias("last_price"), F.count(F.lit(1)).alias("n_prices"))
    diff = F.col("last_price") - F.col("first_price")
    return own.withColumns({"diff": diff, "pct": F.bround(F.try_divide(diff * 100.0, F.col("first_price")), 1), "direction": F.when(diff > 0, "up").when(diff < 0, "down").otherwise("stable")})


def with_extremes(saved: DataFrame, history: DataFrame) -> DataFrame:
    return saved.join(extremes(history), "listing_key", "left")


def series(history: DataFrame, key: str = "listing_key") -> DataFrame:
    """Each price with the one before."""
    order = [c for c in ("checked_at", "seq") if c in history.columns]
    return history.withColumn("prev_price", F.lag("price").over(Window.partitionBy(key).orderBy(*order))).withColumn("change", F.col("price") - F.col("prev_price"))


def drops(history: DataFrame, key: str = "listing_key") -> DataFrame:
    return series(history, key).filter("change < 0")


def nested(history: DataFrame, key: str = "listing_key") -> DataFrame:
    return history.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("checked_at", "price"))).alias("series"))


def as_of(history: DataFrame, asks: DataFrame, key: str = "listing_key", ask_at: str = "at") -> DataFrame:
    """asks (key, at): each with the price valid then, by one window over both tables' union."""
    seq = F.col("seq") if "seq" in history.columns else F.lit(0)
    both = history.select(key, F.col("checked_at").alias("t"), seq.cast("long").alias("s"), "price", F.lit(0).alias("ask")).unionByName(
        asks.select(key, F.col(ask_at).alias("t"), F.lit(2**62).alias("s"), F.lit(None).cast(history.schema["price"].dataType).alias("price"), F.lit(1).alias("ask"))
    )
    w = Window.partitionBy(key).orderBy("t", "ask", "s").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("price", F.last("price", True).over(w)).filter("ask = 1").select(key, F.col("t").alias(ask_at), "price")


def price_check(saved: DataFrame, detail: DataFrame, known_sources: list[str]) -> DataFrame:
    """Saved rows held against re-read pages: new price, or why there is none."""
    joined = saved.join(detail.select("url", F.col("price").alias("new_price"), "gone"), "url", "left")
    reason = F.when(F.coalesce(F.col("url"), F.lit("")) == "", "no url").when(~F.col("source").isin(*known_sources), "unknown source").when(F.col("gone"), "gone").when(F.col("new_price").isNull(), "no price")
    return joined.withColumn("reason", reason).withColumn("changed", reason.isNull() & ~F.col("new_price").eqNullSafe(F.col("price")))


def rate_for(rates: DataFrame, currency: str, now: Column, constant: float, fresh_hours: int = 1) -> DataFrame:
    """One row: the latest rate if fresh, else the latest at all, else the constant."""
    own = rates.filter(F.col("currency") == currency)
    fresh = F.col("as_of") >= now - F.expr(f"INTERVAL {fresh_hours} HOURS")
    return own.agg(F.coalesce(F.max_by(F.when(fresh, F.col("rate")), F.when(fresh, F.col("as_of"))), F.max_by("rate", "as_of"), F.lit(constant)).alias("rate"))
