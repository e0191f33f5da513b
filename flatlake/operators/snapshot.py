"""Merging runs into the kept snapshot, dimensions and price logs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .skew import fresh_path

KEY = ["source", "url"]


def merge(kept: DataFrame, seen: DataFrame, as_of: Column) -> DataFrame:
    """kept: the snapshot (source, url, price, ..., first_seen). seen: this run's rows, one per key. A row seen
    replaces the kept one; first_seen stays or is as_of. is_new is false for known keys, true for new ones
    with a URL, else null; price_changed and prev_price tell of a different known price. A rating that was given to a
    kept row (not 0) is the prev_rating of the row that replaces it. Rows not seen stay, without the flags of earlier runs."""
    flags = ["first_seen", "is_new", "price_changed", "prev_price", "prev_rating", "seen"]
    rated = "rating" in kept.columns
    fields = [c for c in seen.columns if c not in (*KEY, *flags)]
    old = [*fields, *(["rating"] if rated and "rating" not in fields else [])]
    k = kept.select(*KEY, "first_seen", *(F.col(c).alias(f"__k_{c}") for c in old), F.lit(True).alias("__kept"))
    s = seen.select(*KEY, *fields, F.lit(True).alias("__seen"))
    joined = s.join(k, KEY, "full_outer")
    was, now = F.col("__kept").isNotNull(), F.col("__seen").isNotNull()
    changed = was & now & F.col("__k_price").isNotNull() & F.col("price").isNotNull() & (F.col("price") != F.col("__k_price"))
    ratings = [F.when(~now, F.col("__k_rating")).alias("rating")] if rated and "rating" not in fields else []
    ratings += [F.when(was & now, F.nullif(F.col("__k_rating"), F.lit(0))).alias("prev_rating")] if rated else []
    return joined.select(
        *KEY,
        *(F.when(now, F.col(c)).otherwise(F.col(f"__k_{c}")).alias(c) for c in fields),
        F.coalesce("first_seen", as_of).alias("first_seen"),
        F.when(now & was, F.lit(False)).when(now & (F.coalesce(F.col("url"), F.lit("")) != ""), F.lit(True)).alias("is_new"),
        F.when(changed, F.lit(True)).alias("price_changed"),
        F.when(changed, F.col("__k_price")).alias("prev_price"),
        *ratings,
        now.alias("seen"),
    )


def not_seen(kept: DataFrame, seen: DataFrame) -> DataFrame:
    return kept.join(seen.select(*KEY).distinct(), KEY, "left_anti")


def upsert(dimension: DataFrame, news: DataFrame, key: str, version: str = "updated_at") -> DataFrame:
    """The latest row of each key; of equally late ones, the new row."""
    both = dimension.withColumn("__v", F.lit(0)).unionByName(news.withColumn("__v", F.lit(1)))
    cols = dimension.columns
    latest = both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(version), F.col("__v"))).alias("r"))
    return latest.select(*(F.col(f"r.{c}").alias(c) for c in cols))


def price_appends(history: DataFrame, now: DataFrame, as_of: Column) -> DataFrame:
    """Rows for the price log: of listings never logged, or whose price differs from the last one logged."""
    last = history.groupBy("listing_key").agg(F.max_by("price", "checked_at").alias("last"))
    joined = now.filter("price IS NOT NULL").join(last, "listing_key", "left")
    return joined.filter(F.col("last").isNull() | (F.col("price") != F.col("last"))).select("listing_key", "price", "currency", as_of.alias("checked_at"))


def delete(saved: DataFrame, history: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given listing_keys."""
    return saved.join(keys, "listing_key", "left_anti"), history.join(keys, "listing_key", "left_anti")


def union_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def collect_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], path: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Runs each source by itself, so that one that fails, in its plan or in its tasks, doesn't take the others along. Its
    rows are written under `path` (else the shared folder). Returns the rows of all that ran, or None, and a table of
    (source, rows, ms, error) as stats.run_summary takes it."""
    path = path or fresh_path(spark, "sources")
    done, report = [], []
    for name, read in sources.items():
        began, error, rows = time.monotonic(), None, 0
        try:
            seen = Observation(f"rows of {name}")
            read().observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{name}")
            rows = int(seen.get["n"])
            done.append(spark.read.parquet(f"{path}/{name}"))
        except Exception as e:  # whatever a source's reader raises is its own failure
            error = f"{type(e).__name__}: {e}"[:500]
        report.append((name, rows, int((time.monotonic() - began) * 1000), error))
    status = spark.createDataFrame(report, "source string, rows long, ms long, error string")
    return (union_sources(*done) if done else None), status
