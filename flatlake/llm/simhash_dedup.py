"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: a document's words are joined into shingles, repeats included; a bit is set if it is set in
over half of the shingles' XXH64 values. Documents link where fingerprints differ in `most` bits or fewer.

The index holds each distinct fingerprint once. Its upper nodes are masked bit patterns: the 64 bits fall
into most + 2 blocks, and as a pair of linked fingerprints differs in `most` blocks at most, it agrees in
two whole blocks. So every fingerprint is put under the pattern that each pair of its blocks makes; a pair
that links meets under one of them at least. Under a pattern, fingerprints are sorted by Gray rank, which
puts those that share bits side by side, and every FAN neighbours form a node that holds the bits they
share; nodes form nodes again. Two nodes' difference is the count of shared bits in which they disagree,
accumulated from the pattern's node downwards, and pairs of whole nodes beyond `most` are pruned at once.

Patterns with over `heavy` fingerprints are split: their fingerprints go under longer patterns, made of
two of most + 2 blocks of the bits that are still free, and so on. That is exact by the same argument, and
after three levels for most = 4 at most 22 bits are free, so a node has a bounded size whatever the data.
Links leave a pattern as one star for each of its components, never as all pairs.

Defined results: null and wordless texts have fingerprint zero and link like any other. Repeated rows and
equal texts share a fingerprint. A null doc_id never is a component_id unless its component has no other.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, col, join_counted, pinned, rows_of
from .components import components

BITS, FAN = 64, 16
LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_UPPER.lower().encode())


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def stirred(x: np.ndarray) -> np.ndarray:
    """Other hashes of the same things."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int = 4, seed: int = 42) -> np.ndarray:
    """The XXH64 values of a UTF-8 text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    own = text.translate(LOWER).split()
    if not own:
        return np.zeros(0, np.uint64)
    line = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    n = max(1, len(own) - words + 1)
    stops = (ends[min(words, len(own)) - 1 :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[:n], stops, strict=True)), np.uint64, n)


def fingerprint(text: bytes, words: int = 4, seed: int = 42, wide: bool = False) -> tuple[int, int]:
    """Of a UTF-8 text; the second number is 64 further bits, or 0 if they aren't asked for."""
    hashes = shingles(text, words, seed)
    if not len(hashes):
        return 0, 0
    return majority(hashes), majority(stirred(hashes)) if wide else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, wide: bool = False) -> DataFrame:
    """Per row: doc_id, key (a hash of the text as it is), and fp and fp2, the fingerprint's bits as longs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), words, wide=wide) if t.is_valid else (0, 0) for t in batch.column("text")]
            longs = np.array(fps, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(longs[:, 0].copy()), pa.array(longs[:, 1].copy())], names=["doc_id", "key", "fp", "fp2"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.xxhash64(col(text_col)).alias("key"), col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, key long, fp long, fp2 long")


def split_bits(free: list[int], most: int) -> list[int]:
    """Masks of the block pairs of these bit numbers."""
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(free), most + 2)]
    return [a | b for a, b in combinations(blocks, 2)]


def deeper(mask: int, most: int) -> list[int]:
    return [mask | m for m in split_bits([b for b in range(BITS) if not mask >> b & 1], most)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    out = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the leaves up: (shared bits' values, mask of shared bits) of each node; a node has FAN children."""
    out = [(fps, np.full(len(fps), 2**64 - 1, np.uint64))]
    ones, zeros = fps, ~fps
    while len(ones) > 1:
        edges = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, edges), np.bitwise_and.reduceat(zeros, edges)
        out.append((ones, ones | zeros))
    return out


def linked_pairs(fps: np.ndarray, most: int, at_once: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of Gray-sorted fingerprints that differ in `most` bits or fewer, in parts. Up to `at_once` pairs are
    there for each level of the tree, however many there are in all."""
    tree = levels(fps)
    todo = [(len(tree) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    step = max(1, at_once // FAN**2)
    while todo:  # depth first; pairs of nodes wait as they are, not as the FAN**2 pairs that each has below
        level, a, b = todo.pop()
        if level and len(a) > step:
            todo.append((level, a[step:], b[step:]))
            a, b = a[:step], b[:step]
        value, mask = tree[level]
        near = bit_count((value[a] ^ value[b]) & mask[a] & mask[b]) <= most
        a, b = a[near], b[near]
        if level == 0:
            if (inside := a < b).any():
                yield a[inside], b[inside]
            continue
        n = len(tree[level - 1][0])
        x = (a[:, None, None] * FAN + np.arange(FAN)[:, None] + np.zeros((1, FAN), np.int64)).ravel()
        y = (b[:, None, None] * FAN + np.zeros((FAN, 1), np.int64) + np.arange(FAN)).ravel()
        keep = (x <= y) & (y < n)
        if keep.any():
            todo.append((level - 1, x[keep], y[keep]))


def stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each of n nodes' component."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, low, high = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(root, high, low)
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def groups_links(batches: Iterator[pa.RecordBatch], most: int, total: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (mask, pattern, fp, fp2) sorted by mask, pattern and Gray rank: links (a, b) inside each pattern."""
    rest: tuple[np.ndarray, ...] | None = None

    def near(fp: np.ndarray, fp2: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        first = bit_count((fp[i] ^ fp[j]).view(np.uint64)).astype(np.int64)
        return (first <= most) & (True if total is None else first + bit_count((fp2[i] ^ fp2[j]).view(np.uint64)) <= total)

    def found(mask: np.ndarray, pattern: np.ndarray, fp: np.ndarray, fp2: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        small = size <= FAN  # one leaf node: all its pairs are compared at once, neighbours at each distance in turn
        group = np.cumsum(new) - 1
        for lag in range(1, FAN):
            if not (size[small] > lag).any():
                break
            i = np.flatnonzero((group[:-lag] == group[lag:]) & small[group[:-lag]])
            i = i[near(fp, fp2, i, i + lag)]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[i + lag])], names=["a", "b"])
        for s, n in zip(start[~small], size[~small], strict=True):
            own, own2 = fp[s : s + n], fp2[s : s + n]
            pairs = ((i[ok], j[ok]) for i, j in linked_pairs(own.view(np.uint64), most) if (ok := near(own, own2, i, j)).any())
            root = stars(int(n), pairs)
            apart = np.flatnonzero(root != np.arange(n))
            if len(apart):
                yield pa.RecordBatch.from_arrays([pa.array(own[apart]), pa.array(own[root[apart]])], names=["a", "b"])

    for batch in batches:
        now = tuple(batch.column(c).to_numpy() for c in ("mask", "pattern", "fp", "fp2"))
        if rest is not None:
            now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        if not len(now[0]):
            continue
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from found(*(x[:cut] for x in now))
        rest = tuple(x[cut:] for x in now)
    if rest is not None and len(rest[0]):
        yield from found(*rest)


def links(fps: DataFrame, most: int = 4, heavy: int = 50_000, total: int | None = None) -> DataFrame:
    """fps: distinct longs in column fp, and fp2. Pairs (a, b) whose closure links all fingerprints within `most`
    bits and, if given, within `total` bits over both numbers."""
    first = split_bits(list(range(BITS)), most)

    def under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longer = {0: first}
        for batch in batches:
            mask, fp, fp2 = (batch.column(c).to_numpy() for c in ("mask", "fp", "fp2"))
            for m in np.unique(mask).tolist():
                own, own2 = fp[mask == m], fp2[mask == m]
                rank = (gray_rank(own.view(np.uint64)) ^ np.uint64(2**63)).view(np.int64)  # in order as signed longs too
                if m not in longer:
                    longer[m] = deeper(m % 2**64, most)
                for d in np.array(longer[m], np.uint64).view(np.int64):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(own), d), own & d, own, own2, rank)], names=["mask", "pattern", "fp", "fp2", "rank"])

    rows, free, parts = fps.select(F.lit(0).cast("long").alias("mask"), "fp", "fp2"), BITS, []
    while True:
        keys = rows.mapInArrow(under, "mask long, pattern long, fp long, fp2 long, rank long")
        free -= 2 * (free // (most + 2))  # at most so many bits are free under a pattern now
        many = None if free <= 22 else pinned(keys.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy).select("mask", "pattern"))
        last = many is None or many.isEmpty()
        light = keys if last else keys.join(many, ["mask", "pattern"], "left_anti")
        in_order = light.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "rank")
        parts.append(in_order.mapInArrow(lambda batches: groups_links(batches, most, total), "a long, b long"))
        if last:
            return reduce(DataFrame.unionByName, parts)
        rows = keys.join(many, ["mask", "pattern"], "left_semi").select("mask", "fp", "fp2")


def classified(docs: DataFrame, id_col: str, text_col: str, words: int, most: int, heavy: int, total: int | None = None) -> DataFrame:
    """Per row: doc_id, key (a hash of its text), fp, root (its component's), component_id."""
    prints = pinned(fingerprints(docs, id_col, text_col, words, total is not None))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("fp2").alias("fp2"), F.count(F.lit(1)).alias("n"))
    roots = components(links(least.select("fp", "fp2"), most, heavy, total)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = pinned(least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = pinned(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints")))
    full = pinned(join_counted(rooted.select("fp", "root", "n"), ids, "root", "prints", F.col("fp")).select("fp", "root", "component_id", "n"))
    return join_counted(prints, full, "fp", "n", F.struct("doc_id", "key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most: int = 4, heavy: int = 50_000) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links)."""
    return classified(docs, id_col, text_col, words, most, heavy).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most: int = 4, heavy: int = 50_000, total: int | None = None) -> DataFrame:
    """The rows of docs, all columns, one of each component: that of the least doc_id. With `total`, fingerprints
    have 64 bits more, and links need `most` bits or fewer in the first 64 and `total` or fewer in all 128, which
    allows a wider search without joining unlike texts."""
    found = classified(docs, id_col, text_col, words, most, heavy, total).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("it"), F.count(F.lit(1)).alias("n")).select("it.key", F.col("it.doc_id").alias("id"), "n")
    return rows_of(docs, F.xxhash64(col(text_col)), id_col, kept)
