"""Quality classification by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model's symbols are UTF-16 units as they are, none of them merged or hashed, so that an n-gram of four is
one long; a text begins as after units of zero. The model grows with the n-grams of the trusted texts and has
no size limit. Tasks count n-grams, Spark sums the counts by n-gram, and all else is further sums and
joins of that sharded table: the lower orders' counts (of how many different symbols stand before), the
contexts' totals and leftover weights, and from the lowest order upwards the probability of each n-gram that
any document has.

Scoring: the n-grams that make up a share of 1 / `held` of the corpus or more, of which there are `held` at
most, are handed to the tasks. All others are joined to the sharded table, as a row for each document and
different n-gram; none of them is a hot key, being rarer than that. Sums by document end it.

A model is sure of texts that it has seen. So that thresholds say something about texts it hasn't, a trusted
document is scored without its own half of the trusted ones (halves by CRC-32 of the id), others by all.

A document's perplexity, by symbol, is compared to a quantile of the trusted documents' perplexities in its
language. Quantiles are exact on log-perplexities rounded to 1/1000, from sorted counts.

Defined results: null texts and texts of nothing but blanks have perplexity null and are not kept. Documents of a language without
trusted documents (or of null language) are held against the quantile of all trusted ones; if there are none,
nothing is known, perplexities are 1, thresholds are null and every other text is kept. Repeated rows
and labels count once per row of docs; a document is trusted if any of its labels is. Rows are numbered, so
docs must read alike twice, as files do. An empty table gives an empty result. Other columns are ignored,
whatever their names. Very long texts are taken in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, pinned

UNIT, ORDER = 16, 4  # bits of a symbol, symbols of an n-gram
MODELS = 3  # of all trusted texts, and without half 1 and half 2
SLOT = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each symbol of the texts, about `most` at a time: the n-gram that ends there, and its text's number."""
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if not text or text.isspace():
            continue
        units = np.concatenate([np.zeros(ORDER - 1, np.uint16), np.frombuffer(text.encode("utf-16-le", "replace"), np.uint16)])
        for a in range(0, len(units) - ORDER + 1, most):
            held.append(units[a : a + most + ORDER - 1])
            rows.append(k)
            size += len(held[-1])
            if size >= most:
                yield joined(held, rows)
                held, rows, size = [], [], 0
    if held:
        yield joined(held, rows)


def joined(stretches: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate(stretches).astype(np.uint64)
    n = len(flat) - ORDER + 1
    gram = flat[:n].copy()
    for k in range(1, ORDER):
        gram <<= np.uint64(UNIT)
        gram |= flat[k : n + k]
    lengths = np.array([len(s) for s in stretches])
    inside = np.ones(n, bool)
    for back in range(1, ORDER):  # n-grams that reach from one stretch into the next
        inside[np.cumsum(lengths)[:-1] - back] = False
    return gram[inside].view(np.int64), np.repeat(np.array(rows), lengths - ORDER + 1)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Adds up the counts (columns) of equal n-grams."""
    gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(gram)
    gram, n = gram[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    return gram[start], np.add.reduceat(n, start, axis=0)


def count_grams(texts: DataFrame, most: int = 2_000_000) -> DataFrame:
    """texts: text, half. (gram, n0, n1, n2): how often each n-gram stands in the texts of half 0, 1 and 2."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            half = batch.column("half").to_numpy()
            for gram, which in grams(batch.column("text").to_pylist()):
                for k in np.unique(half[which]):
                    own, n = np.unique(gram[half[which] == k], return_counts=True)
                    held.append((own, n[:, None] * (np.arange(3) == k)))
                if sum(len(g) for g, _ in held) > most:
                    held = [summed(held)]
                    if len(held[0][0]) > most // 2:
                        yield from counted(*held.pop())
        if held:
            yield from counted(*summed(held))

    def counted(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(gram), 100_000):
            part = n[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(gram[k : k + 100_000]), *(pa.array(part[:, j].copy()) for j in range(3))], names=["gram", "n0", "n1", "n2"])

    found = texts.mapInArrow(count, "gram long, n0 long, n1 long, n2 long")
    return found.groupBy("gram").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(3)))


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken from counts of 1, 2 and 3 or more, by the numbers of n-grams that have counts of 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(out, 1)]


def less(counts: DataFrame) -> tuple[list[Column], int]:
    """counts: c0, c1, ... of each model. What modified Kneser-Ney takes from each, and how many n-grams model 0 has."""
    names = [f"c{m}" for m in range(MODELS)]
    row = counts.agg(F.count(F.when(F.col("c0") > 0, 1)).alias("known"), *(F.count(F.when(F.col(c) == k, 1)).alias(f"{c}_{k}") for c in names for k in (1, 2, 3, 4))).first()
    out = []
    for c in names:
        d1, d2, d3 = discounts_of(*(row[f"{c}_{k}"] for k in (1, 2, 3, 4)))
        out.append(F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, d1).when(F.col(c) == 2, d2).otherwise(d3))
    return out, row["known"]


def probabilities(counts: DataFrame) -> DataFrame:
    """counts: as from count_grams. (gram, p0, p1, p2): of each n-gram, its last symbol's probability after the others, in
    each model. Model 1 is learned from half 2 and model 2 from half 1."""
    every = range(MODELS)
    level = counts.select("gram", *(n.alias(f"c{m}") for m, n in enumerate([F.col("n1") + F.col("n2"), F.col("n2"), F.col("n1")])))
    levels = []
    for order in range(ORDER, 0, -1):
        levels.append(level if order == ORDER else pinned(level))
        suffix = F.col("gram").bitwiseAND((1 << UNIT * (order - 1)) - 1)
        level = levels[-1].groupBy(suffix.alias("gram")).agg(*(F.count(F.when(F.col(f"c{m}") > 0, 1)).alias(f"c{m}") for m in every))
    found = None
    for order, level in enumerate(reversed(levels), 1):
        taken, known = less(level)
        context = F.shiftrightunsigned("gram", UNIT).alias("context")
        totals = level.groupBy(context).agg(*(F.sum(f"c{m}").alias(f"t{m}") for m in every), *(F.sum(taken[m]).alias(f"l{m}") for m in every))
        rows = level.select("*", context, F.col("gram").bitwiseAND((1 << UNIT * (order - 1)) - 1).alias("suffix")).join(totals, "context")
        lower = [F.lit(1 / (known + 1))] * MODELS  # of all known symbols and one for the others
        if found is not None:
            rows, lower = rows.join(found.withColumnsRenamed({"gram": "suffix"} | {f"p{m}": f"q{m}" for m in every}), "suffix"), [F.col(f"q{m}") for m in every]
        share = [F.coalesce(F.try_divide(F.col(f"c{m}") - taken[m], F.col(f"t{m}")), F.lit(0.0)) for m in every]
        weight = [F.coalesce(F.try_divide(f"l{m}", f"t{m}"), F.lit(1.0)) for m in every]  # an unseen context leaves all to the lower order
        found = rows.select("gram", *((share[m] + weight[m] * lower[m]).alias(f"p{m}") for m in every))
    return found


class Held:
    """The losses of the n-grams that tasks hold; found by a slot each, and by search where two share one."""

    def __init__(self, gram: np.ndarray, loss: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.loss = gram[order], loss[:, order]

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram its number, and whether it is there."""
        if not len(self.gram):
            return np.zeros(len(gram), np.int64), np.zeros(len(gram), bool)
        if not hasattr(self, "slots"):
            self.slots = np.zeros(1 << 21, np.int32)
            self.slots[self._slot(self.gram)] = np.arange(len(self.gram))
        at = self.slots[self._slot(gram)]
        rest = np.flatnonzero(self.gram[at] != gram)
        at[rest] = np.minimum(np.searchsorted(self.gram, gram[rest]), len(self.gram) - 1)
        return at, self.gram[at] == gram

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.view(np.uint64) * SLOT) >> np.uint64(43)).view(np.int64)


FOUND = "rare boolean, gram long, rid long, half int, n long, loss double"


def score(rows: DataFrame, held: Held) -> DataFrame:
    """rows: rid, text, half. For each row the sum of its held n-grams' losses, and a row for each of its others. Sums have
    the rid in place of the n-gram, so that they are spread when joined."""
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, half = batch.column("rid").to_numpy(), batch.column("half").to_numpy()
            for gram, which in grams(batch.column("text").to_pylist()):
                at, there = shared.value.find(gram)
                first, last = which[0], which[-1] + 1
                mine = which[there]
                loss = np.bincount(mine - first, shared.value.loss[half[mine], at[there]], minlength=last - first)
                n = np.bincount(mine - first, minlength=last - first)
                some = np.flatnonzero(n) + first
                yield found(False, rid[some], rid[some], half[some], n[some - first], pa.array(loss[some - first], pa.float64()))
                gram, which = gram[~there], which[~there]
                order = np.lexsort((which, gram))
                gram, which = gram[order], which[order]
                start = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (which[1:] != which[:-1])])) if len(gram) else np.zeros(0, np.int64)
                n, gram, which = np.diff(np.append(start, len(gram))), gram[start], which[start]
                for k in range(0, len(gram), 100_000):
                    part = slice(k, k + 100_000)
                    yield found(True, gram[part], rid[which[part]], half[which[part]], n[part], pa.nulls(len(gram[part]), pa.float64()))

    def found(rare: bool, gram: np.ndarray, rid: np.ndarray, half: np.ndarray, n: np.ndarray, loss: pa.Array) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(rid), rare)), pa.array(gram), pa.array(rid), pa.array(half.astype(np.int32)), pa.array(n.astype(np.int64)), loss]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    return rows.mapInArrow(find, FOUND)


def losses(rows: DataFrame, held: int) -> DataFrame:
    """rows: rid, text, half (0: not trusted). (rid, loss): the mean negative log-probability of a symbol, of each row that has any."""
    counts = pinned(count_grams(rows.select("text", "half")))
    of_all = counts.select("gram", (F.col("n0") + F.col("n1") + F.col("n2")).alias("n"))
    total = of_all.agg(F.sum("n")).first()[0] or 0
    every = [f"loss{m}" for m in range(MODELS)]
    table = probabilities(counts).select("gram", *((-F.log(f"p{m}")).alias(every[m]) for m in range(MODELS)))
    table = pinned(table.join(of_all, "gram"))
    often = F.col("n") * held >= total  # `held` rows at most: each has a share of 1 / held or more
    top = table.filter(often).select("gram", *every).toArrow()
    arrays = Held(top["gram"].to_numpy(), np.stack([top[c].to_numpy() for c in every]).astype(np.float32))
    rare = table.filter(~often).select(F.lit(True).alias("rare"), "gram", *every)
    own = F.element_at(F.array(*every), F.col("half") + 1)
    sums = score(rows, arrays).join(rare, ["rare", "gram"], "left").groupBy("rid")
    return sums.agg((F.sum(F.coalesce("loss", F.col("n") * own)) / F.sum("n")).alias("loss"))


def quantiles(scored: DataFrame, q: float) -> DataFrame:
    """scored: lang, bin. The least bin, by lang (null: all), that has a share q or more at or below it."""
    counts = scored.groupBy("lang", "bin").count()
    both = counts.filter("lang is not null").unionByName(counts.groupBy("bin").agg(F.sum("count").alias("count")).select(F.lit(None).cast("string").alias("lang"), "bin", "count"))
    own = Window.partitionBy("lang")
    sums = both.withColumn("upto", F.sum("count").over(own.orderBy("bin"))).withColumn("all", F.sum("count").over(own))
    return sums.filter(F.col("upto") >= q * F.col("all")).groupBy("lang").agg(F.min("bin").alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality", q: float = 0.99, broadcast_ids: int = 1_000_000, held: int = 1 << 20) -> DataFrame:
    """Per row: doc_id, lang, trusted, perplexity, threshold, keep. Trusted are documents with a label of 1."""
    good = labels.filter(col(quality_col) == 1).select(col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    few = good.count() <= broadcast_ids  # else texts are shuffled to them
    known = good.withColumn("trusted", F.lit(True))
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(lang_col).alias("lang"), col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.join(F.broadcast(known) if few else known, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    rows = rows.withColumn("half", F.when(F.col("trusted"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 + 1).otherwise(0).cast("int"))
    scored = rows.select("rid", "doc_id", "lang", "trusted").join(losses(rows.select("rid", "text", "half"), held), "rid", "left")
    scored = pinned(scored.withColumn("bin", F.round(F.col("loss") * 1000).cast("long")))
    limits = quantiles(scored.filter("trusted and bin is not null"), q)
    of_all = limits.filter("lang is null").select(F.col("limit").alias("limit_of_all")).first()
    marked = scored.join(limits.filter("lang is not null"), "lang", "left").withColumn("limit", F.coalesce("limit", F.lit(of_all[0] if of_all else None).cast("long")))
    keep = F.col("bin").isNotNull() & F.coalesce(F.col("bin") <= F.col("limit"), F.lit(True))
    return marked.select("doc_id", "lang", "trusted", F.exp("loss").alias("perplexity"), F.exp(F.col("limit") / 1000).alias("threshold"), keep.alias("keep"))
