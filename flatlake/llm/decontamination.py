"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and underscores, lower-cased. A mask such as 11101011 hashes the words
at its 1s and ignores those at its 0s, so that a hit survives a substituted word at a 0. The masks'
hashes of the benchmark are joined to those of every place in every document, and around each hit the
item is laid along the document and compared word by word: a window of 13 words in which 11 or more agree
(0.8 and over) is an overlap. The two masks for it hit every such window, wherever its two substitutions
are (a test goes through all of them). Items of 8 to 12 words must agree as a whole but for one word, and
shorter ones exactly; their masks are four ones, and one for each word.

A benchmark of `block_bytes` of text at most is indexed as a whole and broadcast, so that nothing of the documents is
shuffled. A larger one stays sharded: its seeds' hashes are joined to those of the documents, each row with the words
around its place, 33 at most, which is all that windows around a hit can hold; the windows that agree are put together
by document, item and alignment. A bitmap of the benchmark's hashes, of 2 ** 27 bits whatever its size, keeps most of the
documents' seeds from being shuffled; it does so less the more bits are set. Either way documents are read once.

Defined results: null and empty texts and items overlap nothing. Repeated items are reported by each
item_id; repeated documents each. Null ids are carried along. Empty tables give empty results. Other
columns are ignored (or kept, by `without_overlaps`), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, pinned

WORD = re.compile(r"\w+")
WINDOW, AGREE = 13, 11
LONG_MASKS, MIDDLE_MASK = ("11101011", "110100111"), "1111"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def terms(n: int) -> tuple[int, int, tuple[str, ...]]:
    """For an item of n words: its window, how many words have to agree in it, and its masks."""
    if n >= WINDOW:
        return WINDOW, AGREE, LONG_MASKS
    return (n, n - 1, (MIDDLE_MASK,)) if n >= 8 else (n, n, ("1" * n,))


def seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where the mask's words are all known (not negative), and their hashes."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in (k for k, c in enumerate(mask) if c == "1"):
        own = ids[k : k + n]
        ok &= own >= 0
        total = (total ^ (own + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    place = np.flatnonzero(ok)
    return place, total[place]


class Index:
    """Benchmark items by the hashes of their masks."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        own = [(i, w) for i, text in items if (w := words(text))]
        self.vocabulary: dict[str, int] = {}
        self.item = [i for i, _ in own]
        self.ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for _, w in own for x in w], np.int64)
        self.length = np.array([len(w) for _, w in own], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.window, self.agree = (np.array([terms(int(n))[k] for n in self.length], np.int64) for k in (0, 1))
        found: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, n in enumerate(self.length):
            for mask in terms(int(n))[2]:
                place, key = seeds(self.ids[self.start[k] : self.start[k] + n], mask)
                found.setdefault(mask, []).append((key, np.full(len(key), k), place))
        self.table = {}
        for mask, parts in found.items():
            key, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            self.table[mask] = key[order], item[order], place[order]

    def overlaps(self, text: str | None) -> list[tuple[int, int]]:
        """(number of the item, its words in overlaps along its best alignment), for the items that overlap."""
        own = words(text)
        ids = np.fromiter(map(self.vocabulary.get, own, repeat(-1)), np.int64, len(own))
        if not (ids >= 0).any():
            return []
        alignments = []
        for mask, (key, item, place) in self.table.items():
            at, h = seeds(ids, mask)
            low, high = np.searchsorted(key, h), np.searchsorted(key, h, "right")
            hit = np.flatnonzero(high > low)
            for k in range(0, len(hit), 10_000):
                low_k, n, at_k = low[hit[k : k + 10_000]], (high - low)[hit[k : k + 10_000]], at[hit[k : k + 10_000]]
                which = np.repeat(low_k - np.cumsum(n) + n, n) + np.arange(n.sum())
                pair = np.stack([item[which], np.repeat(at_k, n) - place[which]])
                alignments.append(np.unique(pair, axis=1))
        if not alignments:
            return []
        best: dict[int, int] = {}
        item, shift = np.unique(np.concatenate(alignments, axis=1), axis=1)
        for k in range(0, len(item), 10_000):
            for i, covered in zip(item[k : k + 10_000].tolist(), self.covered(ids, item[k : k + 10_000], shift[k : k + 10_000]).tolist(), strict=True):
                if covered > best.get(i, 0):
                    best[i] = covered
        return sorted(best.items())

    def covered(self, ids: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """For items laid along the document from `shift` on: how many of their words overlapping windows hold."""
        n = self.length[item]
        ends = np.cumsum(n)
        begin = ends - n
        nth = np.arange(ends[-1]) - np.repeat(begin, n)
        at = nth + np.repeat(shift, n)
        inside = (at >= 0) & (at < len(ids))
        equal = inside & (ids[np.clip(at, 0, len(ids) - 1)] == self.ids[np.repeat(self.start[item], n) + nth])
        sums = np.concatenate([[0], np.cumsum(equal)])
        window = np.repeat(self.window[item], n)
        last = np.minimum(np.arange(ends[-1]) + window, ends[-1])
        good = (nth + window <= np.repeat(n, n)) & (sums[last] - sums[:-1] >= np.repeat(self.agree[item], n))
        edge = np.zeros(ends[-1] + 1, np.int64)
        np.add.at(edge, np.flatnonzero(good), 1)
        np.add.at(edge, last[good], -1)
        return np.add.reduceat((np.cumsum(edge)[:-1] > 0).astype(np.int64), begin)


#: Bits of the bitmap of the benchmark's hashes.
BITMAP = 27
AROUND = WINDOW - 1
SEED = "h long, mask int, at int, context binary"


def hashed(own: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w.encode("utf-8", "replace")) for w in own), np.uint64, len(own))


def masks() -> list[str]:
    return [*LONG_MASKS, MIDDLE_MASK, *("1" * n for n in range(1, 8) if "1" * n != MIDDLE_MASK)]


def seed_rows(own: np.ndarray, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each mask, its number and the hashes at all places."""
    for number in wanted:
        mask = masks()[number]
        n = len(own) - len(mask) + 1
        if n > 0:
            total = np.full(n, len(mask) + 31 * number, np.uint64)
            for k in (k for k, c in enumerate(mask) if c == "1"):
                total = (total ^ own[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(29)
            yield number, total


def context(own: np.ndarray, at: int, span: int) -> bytes:
    """Of the words, those that windows around a seed can hold, from AROUND before it on; zeros stand for none."""
    out = np.zeros(span + 2 * AROUND, np.uint64)
    low, high = max(0, at - AROUND), min(len(own), at + span + AROUND)
    out[low - at + AROUND : high - at + AROUND] = own[low:high]
    return out.tobytes()


def good_windows(doc: bytes, item: bytes, window: int, agree: int) -> np.ndarray:
    """Where windows begin, from AROUND before the seed, that lie inside the item and agree."""
    d, i = np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64)
    sums = np.concatenate([[0], np.cumsum((d == i) & (i != 0))])
    inside = np.concatenate([[0], np.cumsum(i != 0)])
    return np.flatnonzero((sums[window:] - sums[:-window] >= agree) & (inside[window:] - inside[:-window] == window))


def joined_overlaps(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """rows: rid, text; benchmark: uid, item_id, text. (rid, uid, item_id, item_words, overlap_words), the documents read once."""

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uid, item, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "item_id", "text")), strict=True):
                own = hashed(words(text))
                for number, h in seed_rows(own, [masks().index(m) for m in terms(len(own))[2]] if len(own) else []):
                    out += [(v, number, k, context(own, k, len(masks()[number])), uid, item, len(own)) for k, v in enumerate(h.view(np.int64).tolist())]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["h", "mask", "place", "item", "uid", "item_id", "item_words"])

    seeds = pinned(benchmark.mapInArrow(item_seeds, "h long, mask int, place int, item binary, uid long, item_id long, item_words int"))
    low = F.col("h").bitwiseAND((1 << BITMAP) - 1)
    set_bits = seeds.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()  # 2 ** (BITMAP - 6) rows at most
    bitmap = np.zeros(1 << (BITMAP - 6), np.int64)
    bitmap[set_bits["word"].to_numpy()] = set_bits["bits"].to_numpy()
    used = [r["mask"] for r in seeds.select("mask").distinct().collect()]  # a row for each mask
    shared = rows.sparkSession.sparkContext.broadcast((bitmap.view(np.uint64), sorted(used)))

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, wanted = shared.value
        for batch in batches:
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text"), strict=True):
                own, out = hashed(words(text.as_py())), []
                for number, h in seed_rows(own, wanted):
                    place = h & np.uint64((1 << BITMAP) - 1)
                    at = np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                    out += [(v, number, k, context(own, k, len(masks()[number])), rid) for k, v in zip(at.tolist(), h[at].view(np.int64).tolist(), strict=True)]
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["h", "mask", "at", "context", "rid"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, at, doc, place, item, uid, item_id, n in zip(*(batch.column(c).to_pylist() for c in ("rid", "at", "context", "place", "item", "uid", "item_id", "item_words")), strict=True):
                window, agree, _ = terms(n)
                out += [(rid, uid, item_id, n, at - place, place - AROUND + int(k)) for k in good_windows(doc, item, window, agree)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["rid", "uid", "item_id", "item_words", "shift", "start"])

    met = rows.mapInArrow(doc_seeds, SEED + ", rid long").join(seeds, ["h", "mask"])
    windows = met.select("rid", "at", "context", "place", "item", "uid", "item_id", "item_words").mapInArrow(verified, "rid long, uid long, item_id long, item_words int, shift long, start long").distinct()
    width = F.least(F.lit(WINDOW), F.col("item_words"))  # shorter items are one window
    following = F.lead("start").over(Window.partitionBy("rid", "uid", "shift").orderBy("start"))
    covered = windows.withColumn("own", F.least(width.cast("long"), F.coalesce(following - F.col("start"), width.cast("long"))))
    aligned = covered.groupBy("rid", "uid", "item_id", "item_words", "shift").agg(F.sum("own").cast("int").alias("overlap_words"))
    return aligned.groupBy("rid", "uid", "item_id", "item_words").agg(F.max("overlap_words").alias("overlap_words"))


def items_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[list[tuple[int | None, str | None]] | None, DataFrame]:
    """The items as a list if they have block_bytes of text at most, else None; and as rows."""
    rows = benchmark.select(col(item_col).cast("long").alias("item_id"), col(text_col).alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = [(r["item_id"], r["text"]) for r in rows.collect()] if total <= block_bytes else None
    return few, rows.withColumn("uid", F.monotonically_increasing_id())


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16_000_000) -> DataFrame:
    """(doc_id, item_id, item_words, overlap_words) of each document and benchmark item that overlap."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    items, sharded = items_of(benchmark, item_col, item_text_col, block_bytes)
    if items is None:
        found = joined_overlaps(rows.select("rid", "text"), sharded)
        return rows.select("rid", "doc_id").join(found, "rid").select("doc_id", "item_id", "item_words", "overlap_words")
    index = docs.sparkSession.sparkContext.broadcast(Index(items))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            hits = [(d, own.item[i], int(own.length[i]), n) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for i, n in own.overlaps(t.as_py())]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in enumerate(kinds)], names=["doc_id", "item_id", "item_words", "overlap_words"])

    return rows.select("doc_id", "text").mapInArrow(find, "doc_id long, item_id long, item_words int, overlap_words int")


def without_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16_000_000) -> DataFrame:
    """The rows of docs, all columns, that overlap no benchmark item."""
    items, sharded = items_of(benchmark, item_col, item_text_col, block_bytes)
    if items is None:
        rows = docs.withColumn("__rid", F.monotonically_increasing_id())
        found = joined_overlaps(rows.select(F.col("__rid").alias("rid"), col(text_col).alias("text")), sharded)
        return rows.join(found.select(F.col("rid").alias("__rid")).distinct(), "__rid", "left_anti").drop("__rid")
    return docs.filter(_clean(docs.sparkSession.sparkContext.broadcast(Index(items)))(col(text_col)))


def _clean(index):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([not index.value.overlaps(t.as_py()) for t in texts], pa.bool_())

    return clean
