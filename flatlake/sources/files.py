"""Reading and writing snapshots, feature tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import grouped, lenient_double, listing_key
from ..operators.filters import has_substance


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; rows without price, rooms and area go, a missing listing_key is computed."""
    df = has_substance(spark.read.schema(schema).json(path))
    key = F.col("listing_key") if "listing_key" in df.columns else F.lit(None).cast("string")
    return df.withColumn("listing_key", F.coalesce(F.nullif(key, F.lit("")), listing_key(F.col("source"), F.col("url"), F.col("title"))))


def read_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame, Observation]:
    """JSON lines as (rows, bad, counts). A line that isn't a record of the schema, with a number that is none or cut short, is
    kept in bad (line, file) instead of becoming a row of nulls. counts.get has rows and bad, once rows were read by an action.
    Blank lines are neither."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    read = lines.withColumn("r", F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})).withColumn("bad", F.col("r").isNull() | F.col("r.__bad").isNotNull())
    counts = Observation()
    seen = read.observe(counts, F.count_if(~F.col("bad")).alias("rows"), F.count_if("bad").alias("bad"))
    return seen.filter("NOT bad").select("r.*").drop("__bad"), read.filter("bad").select(F.col("value").alias("line"), "file"), counts


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, perhaps after a byte order mark; rows without price go."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    return df.withColumn("price", lenient_double(F.col("price"))).filter("price IS NOT NULL")


def write_features(df: DataFrame, path: str, columns: list[str]) -> int:
    """Columns in this order, then tag_list, row_key, url and title, then all others by name. Returns the row count,
    observed while writing."""
    tail = [c for c in ("tag_list", "row_key", "url", "title") if c in df.columns and c not in columns]
    order = [*(c for c in columns if c in df.columns), *tail]
    order += sorted(c for c in df.columns if c not in order)
    rows = Observation("rows")
    seen = df.select(*order).observe(rows, F.count(F.lit(1)).alias("n"))
    seen.select(*(seen[c].alias(f"﻿{c}" if k == 0 else c) for k, c in enumerate(order))).write.csv(path, header=True)
    return int(rows.get["n"])


def build_dataset(cached: DataFrame, saved: DataFrame, use_cached: bool = True, use_saved: bool = True, with_price_only: bool = False, min_price: int | None = None) -> DataFrame:
    parts = [p for p, use in ((cached, use_cached), (saved, use_saved)) if use]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    if with_price_only or min_price is not None:
        out = out.filter(F.col("price") > 0)
    return out.filter(F.col("price") >= min_price) if min_price is not None else out


def report_blocks(top: DataFrame, order: list[Column], rows: int = 1000) -> DataFrame:
    """(n, block): a text block for each of the first `rows` listings, numbered in order; missing values are dashes."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("—"))
    price = F.coalesce(grouped(F.col("price")), F.lit("—"))
    n = F.row_number().over(Window.orderBy(*order))  # a top list has one page of rows
    numbered = top.orderBy(*order).limit(rows).withColumn("n", n)
    return numbered.select("n", F.concat_ws("\n", F.concat(F.col("n").cast("string"), F.lit(". "), dash("title")), F.concat(F.lit("price: "), price), F.concat(F.lit("rooms: "), dash("rooms"), F.lit(", area: "), dash("area")), F.concat(F.lit("address: "), dash("address")), F.concat(F.lit("url: "), dash("url"))).alias("block"))


def unique_urls(photos: Column) -> Column:
    """http(s) URLs, trimmed, each once, in order."""
    return F.array_distinct(F.filter(F.transform(photos, lambda x: F.trim(x)), lambda u: u.rlike("^https?://")))


def merged_photos(card: Column, gallery: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(card, F.array().cast("array<string>")), F.coalesce(gallery, F.array().cast("array<string>"))))


def report_table(df: DataFrame, order: list[Column], per_listing: int, in_all: int, rows: int = 1000) -> DataFrame:
    """A report's first `rows` rows in order, with their photos: `per_listing` each and `in_all` over all at most."""
    own = df.orderBy(*order).limit(rows).withColumn("photos", F.slice(unique_urls(F.col("photos")), 1, per_listing))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size("photos")).over(w), F.lit(0))
    cut = own.withColumn("__left", F.greatest(F.lit(0), F.lit(in_all) - before))
    return cut.withColumn("photos", F.slice("photos", F.lit(1), F.least(F.col("__left"), F.size("photos").cast("bigint")).cast("int"))).drop("__left")
