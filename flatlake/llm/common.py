"""Small helpers that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HELD, MANY, fresh_path, join_counted, pinned, shared_dir

__all__ = ["ASCII_UPPER", "ascii_lower", "col", "first_of_equal", "fresh_path", "gathered", "join_counted", "pinned", "rows_of", "shared_dir"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def gathered(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """df in as many partitions as so many rows need, if it has more, without a shuffle. A task's shuffle and checkpoint files take a
    block of disk each, however little they hold; so a loop over few rows would fill the disk with files of empty partitions."""
    return df.coalesce(4 + math.ceil(rows / each))


def first_of_equal(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row of those with equal keys; ties beyond `order` are between rows alike in all it names."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def rows_of(docs: DataFrame, key: Column, id_col: str, kept: DataFrame, held: int = HELD, many: int = MANY) -> DataFrame:
    """The rows of docs, all columns, whose key and id are a row (key, id, n) of kept; of rows alike in both, one.
    The join and the choice have the same keys, none of them null, so that the texts are shuffled once. n is how many
    rows have the key, or more: keys with very many rows are chosen from inside each task before they are shuffled."""
    names = ["__key", "__id", "__none"]
    parts = lambda k, i: {"__key": k, "__id": F.coalesce(i.cast("string"), F.lit("")), "__none": i.isNull()}
    wanted = pinned(kept.select(*(c.alias(n) for n, c in parts(F.col("key"), F.col("id")).items()), "n"))
    mine = docs.withColumns(parts(key, col(id_col)))
    order = [col(c) for c, kind in docs.dtypes if kind in ("string", "bigint", "int", "double", "date", "timestamp")] or [F.col("__key")]
    total = wanted.agg(F.sum("n")).first()[0] or 0
    often = (F.col("n") >= many) & (F.col("n") * held >= total)
    top = wanted.filter(often).select(*names)  # `held` rows at most
    if top.isEmpty():
        return first_of_equal(mine.join(wanted.select(*names), names, "left_semi"), [F.col(n) for n in names], [c.asc_nulls_last() for c in order]).drop(*names)
    rare = mine.join(F.broadcast(top), names, "left_anti").join(wanted.filter(~often).select(*names), names, "left_semi")
    rare = first_of_equal(rare, [F.col(n) for n in names], [c.asc_nulls_last() for c in order]).drop(*names)
    ranked = F.struct(*(x for c in order for x in (c.isNull(), c)))
    best = mine.join(F.broadcast(top), names, "left_semi").groupBy(*names).agg(F.min_by(F.struct(*map(col, docs.columns)), ranked).alias("__row"))
    return rare.unionByName(best.select(*(F.col("__row")[c].alias(c) for c in docs.columns)))
