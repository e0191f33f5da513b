"""Counts, group statistics and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import join_counted, pinned, quantile_by, quantile_sets, ranks


def per_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


def shown_hidden(df: DataFrame, test: Column) -> DataFrame:
    shown = F.count_if(F.coalesce(test, F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("total"), shown.alias("shown"), (F.count(F.lit(1)) - shown).alias("hidden"))


def per_district(df: DataFrame, names: list[str]) -> DataFrame:
    """By the assigned district, else a name in the address, else unknown."""
    text = F.coalesce(*(F.when(F.lower("address").contains(n.lower()), F.lit(n)) for n in names), F.lit("unknown"))
    return df.groupBy(F.coalesce(F.col("district"), text).alias("district")).agg(F.count(F.lit(1)).alias("n"))


def phone_repeats(df: DataFrame, phone: str = "phone") -> DataFrame:
    """Each row with the number of rows of the same digits; 0 without digits, as those are no key and aren't joined."""
    digits = F.regexp_replace(F.coalesce(F.col(phone), F.lit("")), "[^0-9]", "")
    own = df.withColumn("digits", digits)
    some = own.filter("digits <> ''")
    counts = some.groupBy("digits").agg(F.count(F.lit(1)).alias("phone_count"))
    found = join_counted(some, counts, "digits", "phone_count", F.struct(*some.columns))
    return found.unionByName(own.filter("digits = ''").withColumn("phone_count", F.lit(0).cast("long")))


def phone_coverage(df: DataFrame) -> DataFrame:
    """source, phone ('' if none), reason: found and missing per source, and a map from reason to count."""
    per = df.groupBy("source", "reason").agg(F.count_if(F.col("phone") != "").alias("found"), F.count_if(F.col("phone") == "").alias("missing"))
    pairs = F.filter(F.collect_list(F.when((F.col("missing") > 0) & F.col("reason").isNotNull(), F.struct("reason", "missing"))), lambda p: p.isNotNull())
    return per.groupBy("source").agg(F.sum("found").alias("found"), F.sum("missing").alias("missing"), F.map_from_entries(F.array_sort(pairs)).alias("reasons"))


def run_summary(runs: DataFrame) -> DataFrame:
    """runs: source, rows, ms, error."""
    failed = F.col("error").isNotNull()
    return runs.agg(F.count_if(~failed & (F.col("rows") > 0)).alias("ok"), F.count_if(~failed & (F.col("rows") == 0)).alias("empty"), F.count_if(failed).alias("failed"), F.sum("rows").alias("rows"), F.sum("ms").alias("ms"))


def group_median(df: DataFrame, keys: list[str], value: str = "price", least: int = 3, name: str = "median") -> DataFrame:
    """Each row with its group's median, or the median of all where the group has fewer than `least` values."""
    levels = pinned(quantile_sets(df, [keys, []], value, 0.5).filter("n > 0"))
    of_all = levels.filter("level = 1").select(F.col("quantile").alias("__all"))
    groups = levels.filter("level = 0").select(F.struct(*keys).alias("__key"), F.col("quantile").alias("__own"), F.col("n").alias("__n"), "rows")
    joined = join_counted(df.withColumn("__key", F.struct(*keys)), groups, "__key", "rows", F.xxhash64(*df.columns)).drop("__key", "rows")
    both = joined.join(F.broadcast(of_all), how="left")  # one row, or none where there is no value
    return both.withColumn(name, F.when(F.col("__n") >= least, F.col("__own")).otherwise(F.col("__all"))).drop("__own", "__n", "__all")


def exclusive_quantile(df: DataFrame, keys: list[str], value: str, q: float, least: int = 1) -> DataFrame:
    """Per group of `least` values or more: the q-quantile by the exclusive method, which puts the k-th of n values
    at k / (n + 1)."""
    return quantile_by(df, keys, value, q, exclusive=True).filter(F.col("n") >= least)


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: median; mean and population deviation (0 becomes 1) after filling with the median."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))).alias("s")).select("s.*")
    medians = quantile_by(stacked, ["column"], "value", 0.5).select("column", F.col("quantile").alias("median"))  # a row a column
    value = F.coalesce("value", "median")
    found = stacked.join(F.broadcast(medians), "column", "left").groupBy("column").agg(F.max("median").alias("median"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return named.join(F.broadcast(found), "column", "left").select("column", "median", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("std"))


def vocabulary(df: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """(column, value): trimmed lower-case values that occur `least` times or more."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias("value")) for c in columns))).alias("s")).select("s.*")
    return stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def daily_activity(events: DataFrame, limit: int = 10) -> DataFrame:
    """user_id, ts: searches a day, and whether they are over the quota."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("over_quota", F.col("n") > limit)


def queue_positions(requests: DataFrame) -> DataFrame:
    """id, requested_at: each request's place, those of one moment by id."""
    return ranks(requests, [F.col("requested_at"), F.col("id")], "position")


def retained(files: DataFrame, limit: int, share: float = 0.9) -> DataFrame:
    """path, used_at, size: the newest files that fit in share of the limit, once all exceed it. Sizes are summed by
    day first, then inside days."""
    day = files.withColumn("__day", F.to_date("used_at"))
    days = day.groupBy("__day").agg(F.sum("size").alias("__s"))
    newer = days.select("__day", F.coalesce(F.sum("__s").over(Window.orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__newer"))  # a row a day
    w = Window.partitionBy("__day").orderBy(F.desc("used_at"), "path").rowsBetween(Window.unboundedPreceding, 0)
    total = days.agg(F.sum("__s").alias("__all"))
    own = day.withColumn("__in", F.sum("size").over(w)).join(newer, "__day").crossJoin(F.broadcast(total))
    return own.withColumn("kept", (F.col("__all") <= limit) | (F.col("__newer") + F.col("__in") <= F.lit(int(limit * share)))).select(*files.columns, "kept")
