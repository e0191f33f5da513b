"""Exact deduplication by skew-safe combining.

Equal texts are found in three steps, and each compares the full normalised text, not its digest
alone: (1) Spark's map-side aggregation merges equal texts inside a task, (2) groups keyed by digest,
text and a salt are merged, (3) the at most `salts` winners of a text are merged into one. A text that
a third of all rows share thus reaches the last step as `salts` rows, and its winner is handed back to the
rows by a broadcast, as only a bounded number of texts can be that common.

Defined results: null text counts as empty, and all empty texts form one group. A null id never wins
against a number; if all ids of a group are null, keep_id is null. Rows that repeat both id and text
are each returned, each counts in group_size, and one of them can be kept. An empty table gives an
empty result. Columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, join_counted, pinned, rows_of

#: Copies of one (id, text) row are spelled out in blocks of this many.
BLOCK = 10_000


def normal_text(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = digest_of) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256. `digest` is for tests of colliding digests."""
    base = docs.select(col(id_col).alias("doc_id"), normal_text(col(text_col)).alias("norm"))
    base = base.withColumn("digest", digest(F.col("norm"))).withColumn("sha", F.unhex(F.sha2("norm", 256)))
    salted = (
        base.groupBy("digest", "norm", (F.spark_partition_id() % salts).alias("salt"))
        .agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    )
    texts = salted.repartition("digest").groupBy("digest", "norm").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = pinned(
        texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    )
    # From here on a row is its id and digest; the copies of one (id, text) row travel as a count.
    alike = ["doc_id", "digest", "sha"]
    alone = winners.filter("n_texts = 1").drop("n_texts")
    counted = base.groupBy(*alike).agg(F.count(F.lit(1)).alias("copies"))
    rows = join_counted(counted, alone, "digest", "group_size", F.col("doc_id")).filter("group_size IS NOT NULL")
    shared = winners.filter("n_texts > 1").select("digest")
    if not shared.isEmpty():  # different texts under one digest: their rows are joined on the text too
        apart = texts.join(shared, "digest", "left_semi")
        both = base.groupBy(*alike, "norm").agg(F.count(F.lit(1)).alias("copies")).join(apart, ["digest", "norm"])
        rows = rows.unionByName(both.select(rows.columns))
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK))))
    each = blocks.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(BLOCK).cast("long"), F.col("copies") - F.col("block") * BLOCK))))
    first = (F.col("block") == 0) & (F.col("nth") == 1)
    return each.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps: one per text."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("text_sha256").alias("key"), F.col("doc_id").alias("id"), F.col("group_size").alias("n"))
    return rows_of(docs, F.sha2(normal_text(col(text_col)), 256), id_col, kept)
