"""Joins and ranks that a very common key or a very large group doesn't send to one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with MANY rows and a share of 1 / HELD of all rows or more is handed to all tasks; there are HELD such keys at most.
HELD, MANY = 50_000, 1000
SPREAD = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster sets it, else (tests, one
    machine) a temporary one. It becomes the session's checkpoint folder if there is none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="flatlake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Spark removes the shuffle files of an execution at its end.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pinned(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared folder, so that lost executors don't repeat it. What it was shuffled by is
    removed from the executors' disks then, not when the driver next happens to collect its garbage."""
    shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, "false")
    try:
        conf.set(CLEANED, "true")
        return df.alias("__pinned").checkpoint(eager=True)  # a plan takes the setting when it is made
    finally:
        conf.set(CLEANED, before)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, spread: Column, total: int | None = None, held: int = HELD, many: int = MANY) -> DataFrame:
    """rows left-joined to keyed, which has one row a key and, in `count`, how many of the rows have it (or more).
    Keys with a share of 1 / held of all or more, `held` at most, are broadcast; their rows go to
    the shuffle join of the others under keys that no row has, spread by a hash of `spread`, and so fill no task."""
    total = total if total is not None else keyed.agg(F.sum(count)).first()[0] or 0
    often = F.coalesce((F.col(count) >= many) & (F.col(count) * held >= total), F.lit(False))
    values = [c for c in keyed.columns if c != key]
    top = keyed.filter(often).select(key, F.struct(*values).alias("__top"))
    rest = keyed.filter(~often).select(key, F.struct(*values).alias("__rest"), F.lit(0).alias("__salt"))
    marked = rows.join(F.broadcast(top), key, "left")
    salted = marked.withColumn("__salt", F.when(F.col("__top").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("int") + 1).otherwise(0))
    joined = salted.join(rest, [key, "__salt"], "left")
    found = F.coalesce("__top", "__rest")
    return joined.select(*(joined[f"`{c}`"] for c in rows.columns), *(found[c].alias(c) for c in values))


def ranks(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place (from 1) in the order of all rows. Ranges of the order are sorted by themselves and
    moved by the sizes of the ranges before, so that no task sees all rows; ties that `order` leaves share a range."""
    ranged = pinned(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = ranged.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = ranged.withColumn("__p", part).join(F.broadcast(before), "__p")
    return placed.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1).drop("__m", "__p", "__before")


def same(left: dict[str, Column], right: dict[str, Column]) -> Column:
    out = F.lit(True)
    for k, v in left.items():
        out = out & v.eqNullSafe(right[k])
    return out


def _upto(counts: DataFrame, keys: list[str], few: int) -> DataFrame:
    """counts (keys, __v, __c) with __upto, the sum of __c up to each __v of its group, and n, that of the group. Over `few`
    rows, ranges of (keys, __v) are summed by themselves and moved by the ranges before, so that no task sees a whole group."""
    group, order = Window.partitionBy(*keys), F.col("__v").asc_nulls_first()
    if counts.count() <= few:
        return counts.withColumns({"__upto": F.sum("__c").over(group.orderBy(order)), "n": F.sum("__c").over(group)})
    by = [*(F.col(k).asc_nulls_first() for k in keys), order]
    ranged = pinned(counts.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "__part").agg(F.sum("__c").alias("__sum"))  # a row for each group and the range it is in
    before = F.coalesce(F.sum("__sum").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = sums.select("__part", *(F.col(k).alias(f"__k_{k}") for k in keys), before.alias("__before"), F.sum("__sum").over(group).alias("n"))
    within = ranged.withColumn("__within", F.sum("__c").over(Window.partitionBy("__part", *keys).orderBy(order)))
    met = within.withColumnRenamed("__part", "__in").join(moved, (F.col("__in") == F.col("__part")) & same({k: F.col(k) for k in keys}, {k: F.col(f"__k_{k}") for k in keys}))
    return met.select(*counts.columns, (F.col("__before") + F.col("__within")).alias("__upto"), "n")


def quantile_sets(df: DataFrame, sets: list[list[str]], value: str | Column, q: float, exclusive: bool = False, few: int = 2_000_000) -> DataFrame:
    """(level, keys, quantile, n, rows) of each group of each set of keys, exactly. level: the set's number in `sets`; keys that
    a set doesn't have are null. n: rows with a value. The usual method puts the k-th of n values at (k - 1) / (n - 1), the
    exclusive one at k / (n + 1). Equal values are counted before they are shuffled, once for all sets, and then ranked."""
    keys = list(dict.fromkeys(k for own in sets for k in own))
    counted = df.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("__v")).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__rows"))
    if sets != [keys]:
        each = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), *((F.col(k) if k in own else F.lit(None).cast(dict(counted.dtypes)[k])).alias(k) for k in keys)) for n, own in enumerate(sets))))
        counted = counted.select(each.alias("__s"), "__v", "__rows").select("__s.*", "__v", "__rows").groupBy("level", *keys, "__v").agg(F.sum("__rows").alias("__rows"))
    else:
        counted = counted.withColumn("level", F.lit(0))
    counted = pinned(counted.withColumn("__c", F.when(F.col("__v").isNotNull(), F.col("__rows")).otherwise(0)))
    by = ["level", *keys]
    at = F.greatest(F.lit(1.0), F.least(F.col("n") - 1.0, F.floor(F.lit(q) * (F.col("n") + 1)))) if exclusive else F.floor(F.lit(q) * (F.col("n") - 1)) + 1.0
    part = F.lit(q) * (F.col("n") + 1) - at if exclusive else F.lit(q) * (F.col("n") - 1) + 1 - at
    holds = lambda k: F.max(F.when((F.col("__upto") >= k) & (F.col("__upto") - F.col("__c") < k), F.col("__v")))
    both = _upto(counted, by, few).groupBy(*by, "n").agg(holds(at).alias("__a"), holds(at + 1).alias("__b"), F.sum("__rows").alias("rows"))
    return both.select(*by, F.when((F.col("n") == 1) | (part == 0), F.col("__a")).otherwise(F.col("__a") * (1 - part) + F.col("__b") * part).alias("quantile"), "n", "rows")


def quantile_by(df: DataFrame, keys: list[str], value: str | Column, q: float, exclusive: bool = False, few: int = 2_000_000) -> DataFrame:
    """(keys, quantile, n) of the groups that have a value, exactly."""
    return quantile_sets(df, [keys], value, q, exclusive, few).filter("n > 0").select(*keys, "quantile", "n")
