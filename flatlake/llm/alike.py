"""Near copies by the Jaccard similarity of their shingles; candidates through the Gray-order index of simhash_dedup.

Sets: the XXH64 values of a text's shingles of `words` words. SimHash alone can't tell 0.8 from 0.7: at 0.8, two
64-bit fingerprints differ in 9.7 bits with a deviation of 2.9. So it finds candidates, and the sets decide.

1. Blocks. Two sets alike by `least` share one of their prefixes' values, a prefix being the size -
   ceil(least * size) + 1 first values of a set in any order that is the same for all sets. The order is from rare to
   frequent values, so that a passage that very many texts share is in the prefixes of those alone that hold little
   else. Frequent values are those with a share of 2 ** -20 of all values or more: 2 ** 20 at most, broadcast.
2. Bounds. Of the values of a set, each of 256 classes holds an odd or an even number; two sets differ in at least as many
   values as in parities, and sets alike by `least` differ in (1 - least) / (1 + least) of both sizes at most. Pairs that
   break this are dropped, which loses none that is alike. Where up to FAN texts share a value, all other pairs are candidates.
3. Index. More texts that share a value are sorted by the Gray rank of their fingerprints and searched by the nodes of that
   order, which prune groups whose shared bits differ too much; each text's `nearest` within `bits` of 128 bits outside
   its component are candidates (at 0.8 the difference is 19.4 with a deviation of 4.1). Components are made anew until a
   round finds no link. This joins most of what is alike in few comparisons, but not all.
4. The rest. Then, inside the task that holds the texts of a value, all pairs of different components meet by the bounds. What has a
   pair there that may be alike goes to the task of the value's head, which is the least of these texts: values that the same texts share
   have the same head, so a text is sent a few times, however many texts there are and values it shares. That task compares all
   pairs that share a value: by parities in one class a value, in four, and by the sets; a head of very many texts is dealt to blocks by size, and
   its pairs of blocks are tasks. Only links leave the task. So every pair that is alike has been compared, or is in one component.
5. Comparison. In steps 2 and 3, the candidates' parities in more classes, and of those left the sets, meet in pairs of blocks, and their similarity
   is measured exactly.

Tests hold all of it against brute force.

Defined results: null and wordless texts have the empty set and are alike to each other, and to nothing else. Equal
texts are one node. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, gathered, pinned, rows_of
from .components import components
from .simhash_dedup import FAN, bit_count, gray_rank, linked_pairs, majority, shingles, stirred

PARITIES = ["p0", "p1", "p2", "p3"]
NODES = "value long, key long, fp long, fp2 long, p0 long, p1 long, p2 long, p3 long, size int"
#: Texts of a block, and bytes of its sets; pairs of blocks are compared.
BLOCK, BLOCK_BYTES = 4096, 32_000_000
#: Rows that are broadcast, at most; beyond, they are joined by a shuffle.
FEW = 1_000_000
#: Classes for each value of a set in the sketches that meet; the finer are for what the coarse leave.
FINER = (1, 4)
#: Texts whose sets a task takes where few are wanted.
SETS = 1250
#: Of a batch of texts, values that fewer of them have aren't counted as frequent.
SEVERAL = 8


def prefix(size: int, least: float) -> int:
    return size - math.ceil(least * size - 1e-9) + 1 if size else 1


def own_set(text: pa.Scalar, words: int) -> np.ndarray:
    return np.unique(shingles(text.as_buffer().to_pybytes(), words)) if text.is_valid else np.zeros(0, np.uint64)


def parities(own: np.ndarray) -> np.ndarray:
    """A bit for each of 256 classes of values: whether the set holds an odd number of it."""
    return np.packbits(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256).astype(np.uint8) & 1).view(np.int64)


def frequent(texts: DataFrame, words: int, held: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The values that make up 1 / held of all or more, sorted, and the number of binary digits of how often each is there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(own_set(t, words) for t in batch.column("text"))]), return_counts=True)
            often = n >= SEVERAL
            value, n = np.append(value[often].view(np.int64), 0), np.append(n[often], n.sum())  # the sum of all under a null
            yield pa.RecordBatch.from_arrays([pa.array(value, mask=np.arange(len(value)) == len(value) - 1), pa.array(n.astype(np.int64))], names=["value", "n"])

    sums = pinned(texts.select("text").mapInArrow(count, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")))
    total = sums.filter("value IS NULL").agg(F.sum("n")).first()[0] or 0
    top = sums.filter("value IS NOT NULL").filter(F.col("n") * held >= total).toArrow()  # `held` rows at most
    value, n = top["value"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(value)
    return value[order], np.floor(np.log2(n[order])).astype(np.int8) + 1


def nodes(texts: DataFrame, words: int, least: float) -> DataFrame:
    """texts: key, text. A row for each value of a text's prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent(texts, words))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, digits = shared.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(9)]
            rows = 0
            for key, text in zip(batch.column("key").to_numpy(), batch.column("text"), strict=True):
                every = shingles(text.as_buffer().to_pybytes(), words) if text.is_valid else np.zeros(0, np.uint64)
                own, head = np.unique(every), np.zeros(1, np.int64)
                prints: tuple | np.ndarray = (0, 0)
                if len(own):
                    often = np.zeros(len(own), np.int8)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                        often = np.where(common[at] == own, digits[at], often)
                    head = own[np.argsort(often, kind="stable")[: prefix(len(own), least)]].view(np.int64)
                    prints = np.array([majority(every), majority(stirred(every))], np.uint64).view(np.int64)
                for store, x in zip(out, (head, *(np.full(len(head), v, np.int64) for v in (key, *prints, *parities(own), len(own)))), strict=True):
                    store.append(x)
                rows += len(head)
                if rows > 200_000:
                    yield packed(out)
                    out, rows = [[] for _ in range(9)], 0
            if rows:
                yield packed(out)

    return texts.mapInArrow(each, NODES)


def packed(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    flat = [np.concatenate(c) for c in columns]
    return pa.RecordBatch.from_arrays([*map(pa.array, flat[:8]), pa.array(flat[8].astype(np.int32))], names=["value", "key", "fp", "fp2", *PARITIES, "size"])


def by_value(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("value",)) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by value, or other keys, cut so that those of a value come together, many values at once."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        if rest is not None:
            now = {c: np.concatenate([rest[c], x]) for c, x in now.items()}
        last = np.flatnonzero(np.any([now[k] != now[k][-1] for k in keys], axis=0)) if len(now["value"]) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield {c: x[:cut] for c, x in now.items()}
        rest = {c: x[cut:] for c, x in now.items()}
    if rest is not None and len(rest["value"]):
        yield rest


def shared_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose value isn't theirs alone."""
    for rows in by_value(batches):
        same = rows["value"][1:] == rows["value"][:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in rows.values()], names=list(rows))


Rows = dict[str, np.ndarray]


def differ(rows: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return bit_count((rows["fp"][i] ^ rows["fp"][j]).view(np.uint64)).astype(np.int64) + bit_count((rows["fp2"][i] ^ rows["fp2"][j]).view(np.uint64))


def possible(rows: Rows, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those of different components whose sizes and parities let them be alike."""
    ok = rows["root"][i] != rows["root"][j]
    i, j = i[ok], j[ok]
    a, b = rows["size"][i].astype(np.int64), rows["size"][j].astype(np.int64)
    ok = np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9
    i, j, most = i[ok], j[ok], ((1 - least) / (1 + least) * (a + b) + 1e-9)[ok]
    apart = np.zeros(len(i), np.int64)
    for p in PARITIES:
        apart += bit_count((rows[p][i] ^ rows[p][j]).view(np.uint64))
    ok = apart <= most
    return i[ok], j[ok]


def near(rows: Rows, i: np.ndarray, j: np.ndarray, least: float, bits: int) -> tuple[np.ndarray, ...]:
    """Of the pairs (i, j), those of different components that may be alike, and in how many bits they differ."""
    i, j = possible(rows, i, j, least)
    d = differ(rows, i, j)
    ok = d <= bits
    return i[ok], j[ok], d[ok]


def nearest_of(rows: Rows, least: float, bits: int, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """For the texts of one value: each one's nearest candidates, by the Gray-order index of the first 64 bits."""
    if (rows["root"] == rows["root"][0]).all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(gray_rank(rows["fp"].view(np.uint64)), kind="stable")
    own = {c: x[order] for c, x in rows.items()}
    held: list[tuple[np.ndarray, ...]] = []

    def first(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        a, b, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((d, a))
        a, b, d = a[by], b[by], d[by]
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        nth = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
        return [(a[nth < nearest], b[nth < nearest], d[nth < nearest])]

    half = bits // 2 + 3  # the first 64 of 128 bits rarely hold more of the differences
    for i, j in linked_pairs(own["fp"].view(np.uint64), half):
        i, j, d = near(own, i, j, least, bits)
        if len(i):
            held += [(i, j, d), (j, i, d)]
            if sum(len(h[0]) for h in held) > 500_000:
                held = first(held)
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, _ = first(held)[0]
    return own["key"][a], own["key"][b]


def candidates(batches: Iterator[pa.RecordBatch], least: float, bits: int, nearest: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of each value's rows: all that may be alike where few texts share the value, else each one's nearest."""
    for rows in by_value(batches):
        edges = np.flatnonzero(np.concatenate([[True], rows["value"][1:] != rows["value"][:-1], [True]]))
        size = np.diff(edges)
        group = np.repeat(np.arange(len(size)), size)
        small = np.repeat(size <= FAN, size)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, min(FAN, int(size.max()))):
            i = np.flatnonzero((group[:-lag] == group[lag:]) & small[:-lag])
            i, j = possible(rows, i, i + lag, least)
            left.append(rows["key"][i])
            right.append(rows["key"][j])
        for k in np.flatnonzero(size > FAN):
            own = {c: x[edges[k] : edges[k + 1]] for c, x in rows.items()}
            # Texts alike in all their bits hang on the first of them, which stands for them.
            print_of = np.stack([own["fp"], own["fp2"], own["size"].astype(np.int64)])
            if (own["root"] != own["key"]).any():  # not the first round: only within a component
                print_of = np.concatenate([print_of, own["root"][None]])
            _, one, which = np.unique(print_of, axis=1, return_index=True, return_inverse=True)
            which = which.ravel()
            left.append(own["key"])
            right.append(own["key"][one[which]])
            a, b = nearest_of({c: x[one] for c, x in own.items()}, least, bits, nearest)
            left.append(a)
            right.append(b)
        a, b = np.concatenate(left), np.concatenate(right)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        for k in range(0, pair.shape[1], 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000].copy()) for x in pair], names=["a", "b"])


def partnered(rows: Rows, least: float, at_once: int = 250_000) -> np.ndarray:
    """Whether each text of one value has another of a different component that it may be alike to. Pairs of some texts are there at once."""
    order = np.argsort(rows["size"], kind="stable")
    own = {c: x[order] for c, x in rows.items()}
    n, has = len(order), np.zeros(len(order), bool)
    after = np.searchsorted(own["size"], own["size"] / least + 1e-9, "right") - np.arange(n) - 1  # larger ones that are not too large
    upto = np.concatenate([[0], np.cumsum(after)])
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + at_once, "right")) - 1)
        i = np.repeat(np.arange(first, last), after[first:last])
        i, j = possible(own, i, i + 1 + np.arange(len(i)) - np.repeat(upto[first:last] - upto[first], after[first:last]), least)
        has[i] = has[j] = True
        first = last
    return has[np.argsort(order)]


def crossed(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of the values that over FAN texts share, the texts that may be alike to one of another component: head (the least key of
    these texts of the value), key, root, size and half of the value's bits."""
    for rows in by_value(batches):
        start = np.flatnonzero(np.concatenate([[True], rows["value"][1:] != rows["value"][:-1]]))
        n = np.diff(np.append(start, len(rows["value"])))
        out: list[list[np.ndarray]] = []
        for k in np.flatnonzero((n > FAN) & (np.minimum.reduceat(rows["root"], start) < np.maximum.reduceat(rows["root"], start))):
            own = {c: x[start[k] : start[k] + n[k]] for c, x in rows.items()}
            has = partnered(own, least)
            if has.any():
                key = own["key"][has]
                out.append([np.full(len(key), key.min()), key, own["root"][has], own["size"][has], own["value"][has].astype(np.int32)])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["head", "key", "root", "size", "half"])


def blocks_of(bands: list[tuple], least: float, block: int) -> tuple[list[tuple], list[tuple]]:
    """bands: number, texts, least and largest size, sum of the sizes; from small to large sets. Returns (band, first block, blocks), and
    (block, i, j) for the pairs of blocks whose sizes let sets be alike."""
    placed, spans, texts, values = [], [], 0, 0
    for band, n, low, high, total in bands:
        parts = max(math.ceil(n / block), math.ceil(total * 8 / BLOCK_BYTES), 1)
        if parts == 1 and spans and texts + n <= block and (values + total) * 8 <= BLOCK_BYTES:
            spans[-1], texts, values = (spans[-1][0], high), texts + n, values + total
            placed.append((band, len(spans) - 1, 1))
        else:
            placed.append((band, len(spans), parts))
            spans += [(low, high)] * parts
            texts, values = (n, total) if parts == 1 else (block, 0)  # a band that is dealt to several blocks is alone in them
    met = [(i, j) for i in range(len(spans)) for j in range(i, len(spans)) if spans[i][1] >= least * spans[j][0] - 1e-9]
    return placed, [(k, i, j) for i, j in met for k in sorted({i, j})]


def folded(sketches: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The length of each sketch's parities, and for each length that there is the parities, folded to it, of the sketches that are as long or
    longer, with the row of each. Sets of like sizes meet by the parities of the smaller, however small others are."""
    each = [np.frombuffer(x, np.uint64, offset=8) for x in sketches]
    length, out = np.array([len(x) for x in each]), {}
    for n in np.unique(length).tolist():
        own = np.flatnonzero(length >= n)
        row = np.zeros(len(each), np.int64)
        row[own] = np.arange(len(own))
        out[n] = row, np.stack([np.bitwise_xor.reduce(each[k].reshape(-1, n), axis=0) for k in own])
    return length, out


def meeting(root: np.ndarray, side: np.ndarray, sketches: list[bytes], shared: list[np.ndarray], least: float, test) -> Iterator[tuple[int, int]]:
    """Pairs (one of side False, one of True; any, if all are of one side) of different components that share one of `shared`, that
    may be alike, and for which test(x, y) holds. A pair makes one component of two, if test is given; else each text comes once or twice."""
    size, (length, bits) = np.array([int(np.frombuffer(x, np.int64, 1)[0]) for x in sketches]), folded(sketches)
    few = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64, offset=8).reshape(-1, 4), axis=0) for x in sketches])
    both = side.any() and not side.all()
    right = np.flatnonzero(side) if both else np.arange(len(side))
    left = np.flatnonzero(~side) if both else right
    value, of = np.concatenate([shared[k] for k in right]), np.repeat(right, [len(shared[k]) for k in right])
    order = np.argsort(value, kind="stable")
    value, of = value[order], of[order]
    _, component = np.unique(root, return_inverse=True)
    hit = np.zeros(len(side), bool)
    for x in left:
        hit[:] = False
        for a, b in zip(np.searchsorted(value, shared[x]), np.searchsorted(value, shared[x], "right"), strict=True):
            hit[of[a:b]] = True
        y = np.flatnonzero(hit & (component != component[x]))
        if not both:
            y = y[y > x]
        y = y[np.minimum(size[y], size[x]) >= least * np.maximum(size[y], size[x]) - 1e-9]
        y = y[bit_count(few[y] ^ few[x]).astype(np.int64).sum(axis=1) <= (1 - least) / (1 + least) * (size[y] + size[x]) + 1e-9]
        apart, shorter = np.zeros(len(y), np.int64), np.minimum(length[y], length[x])
        for n in np.unique(shorter).tolist():
            row, by = bits[n]
            apart[shorter == n] = bit_count(by[row[y[shorter == n]]] ^ by[row[x]]).astype(np.int64).sum(axis=1)
        ok = apart <= (1 - least) / (1 + least) * (size[y] + size[x]) + 1e-9  # sets differ in as many values as in parities, or more
        y, apart = y[ok], apart[ok]
        for k in y[np.argsort(apart, kind="stable")]:
            if test is None:
                yield int(x), int(k)
            elif component[k] != component[x] and test(x, k):
                component[component == component[k]] = component[x]
                yield int(x), int(k)


def crossing(texts: DataFrame, rows: DataFrame, words: int, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join all texts that are alike, of different components, and share a value that over FAN texts have.
    A task has the texts of a head, or of a pair of blocks of one that has over `block` texts, dealt by the sizes of their sets. First
    their sketches meet, coarse ones and then finer ones, and what has a pair there that may be alike is named. Then the sets of these are compared. Pairs never leave a task:
    texts and links do, each text once for a head, so that what is shuffled grows neither with the number of pairs nor with that of other texts."""
    spark = texts.sparkSession
    each = rows.mapInArrow(lambda b: crossed(b, least), "head long, key long, root long, size int, half int")
    each = pinned(each.groupBy("head", "key").agg(F.first("root").alias("root"), F.first("size").alias("size"), F.collect_set("half").alias("shared")))
    n = each.count()
    if not n:
        return spark.createDataFrame([], "a long, b long")
    each = gathered(each, n, SETS)
    band = F.floor(F.log1p("size") * 100).cast("int")
    large = each.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("values")).filter((F.col("n") > block) | (F.col("values") * 8 > BLOCK_BYTES)).select("head")
    sums = each.join(F.broadcast(large), "head", "left_semi").groupBy("head", band.alias("band")).agg(F.count(F.lit(1)), F.min("size"), F.max("size"), F.sum("size"))
    bands: dict[int, list[tuple]] = {}
    for head, *one in sums.collect():  # some hundreds for each of few heads
        bands.setdefault(head, []).append(tuple(one))
    placed, met = [], []
    for head, own in bands.items():
        blocks, pairs = blocks_of(sorted(own), least, block)
        placed += [(head, *x) for x in blocks]
        met += [(head, *x) for x in pairs]
    where, meets = spark.createDataFrame(placed, "head long, band int, first int, parts int"), spark.createDataFrame(met, "head long, block int, i int, j int")

    def made(named: DataFrame, of) -> DataFrame:
        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([of(own_set(t, words)) for t in batch.column("text")], pa.binary())], names=["key", "held"])

        some = texts.join(F.broadcast(named) if named.count() <= FEW else named, "key", "left_semi")
        return some.mapInArrow(members, "key long, held binary").groupBy("key").agg(F.first("held").alias("held"))

    def pairs_of(part: pa.Table, sets: bool) -> tuple[np.ndarray, Iterator[tuple[int, int]]]:
        key, root, i, at = (part.column(c).to_numpy() for c in ("key", "root", "i", "block"))
        if (root == root[0]).all() or i[0] != part.column("j")[0].as_py() and (at == at[0]).all():
            return key, iter(())
        held, shared = [x.as_buffer().to_pybytes() for x in part.column("held")], [x.values.to_numpy() for x in part.column("shared")]
        if not sets:
            return key, meeting(root, at != i, held, shared, least, None)
        own = [np.frombuffer(x, np.uint64) for x in held]
        return key, meeting(root, at != i, [sketch(x, 4) for x in own], shared, least, lambda x, y: sets_alike(own[x], own[y], least))

    def named_ones(part: pa.Table) -> list[np.ndarray]:
        key, pairs = pairs_of(part, False)
        near_ones = np.zeros(len(key), bool)
        for pair in pairs:
            near_ones[list(pair)] = True
        return [part.column(c).to_numpy()[near_ones] for c in ("head", "i", "j", "key")]

    def links(part: pa.Table) -> list[np.ndarray]:
        key, pairs = pairs_of(part, True)
        a, b = key[np.array([*pairs], np.int64).reshape(-1, 2)].T
        return [np.minimum(a, b), np.maximum(a, b)]

    def meet(rows: DataFrame, use, names: list[str], schema: str) -> DataFrame:
        task = ["head", "i", "j"]

        def each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: list[pa.RecordBatch] = []
            here: tuple | None = None
            for batch in batches:
                at = [batch.column(c).to_numpy() for c in task]
                cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
                for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                    if start == end:
                        continue
                    was, here = here, tuple(x[start] for x in at)
                    if parts and was != here:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, use(pa.Table.from_batches(parts)))], names=names)
                        parts = []
                    parts.append(batch.slice(start, end - start))
            if parts:
                yield pa.RecordBatch.from_arrays([*map(pa.array, use(pa.Table.from_batches(parts)))], names=names)

        return rows.repartition(*task).sortWithinPartitions(*task).mapInArrow(each_pair, schema)

    block_of = F.coalesce(F.col("first") + F.pmod("key", "parts"), F.lit(0)).cast("int")  # without a row in `where`, a head is one block
    dealt = each.withColumn("band", band).join(F.broadcast(where), ["head", "band"], "left").select("head", "key", "root", "shared", block_of.alias("block"))
    named, m = dealt.join(F.broadcast(meets), ["head", "block"], "left").fillna(0, ["i", "j"]), n
    for finer in FINER:
        drawn = gathered(named.join(made(named.select("key").distinct(), lambda own, finer=finer: sketch(own, finer)), "key"), m, SETS)
        found = pinned(meet(drawn, named_ones, ["head", "i", "j", "key"], "head long, i int, j int, key long"))
        if not (m := found.count()):
            return spark.createDataFrame([], "a long, b long")
        named = gathered(dealt.join(gathered(found, m), ["head", "key"]), m, SETS)
    whole = gathered(named.join(made(named.select("key").distinct(), np.ndarray.tobytes), "key"), m, SETS)
    return meet(whole, links, ["a", "b"], "a long, b long").distinct()


def sketch(own: np.ndarray, finer: int = 1) -> bytes:
    """A set's size, and its parities in `finer` times as many classes as it has values, or up to twice as many, and 256 at least."""
    m = max(256, 1 << max(0, finer * len(own) - 1).bit_length())
    bits = np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1
    return np.int64(len(own)).tobytes() + np.packbits(bits).tobytes()


def sketches_near(x: bytes, y: bytes, least: float) -> bool:
    """False only if the sets can't be alike by `least`."""
    a, b = (np.frombuffer(v, np.uint8, offset=8) for v in (x, y))
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    both = sum(int(np.frombuffer(v, np.int64, 1)[0]) for v in (x, y))
    return int(bit_count(a ^ b).sum()) <= (1 - least) / (1 + least) * both + 1e-9


def sets_alike(x: np.ndarray | bytes, y: np.ndarray | bytes, least: float) -> bool:
    x, y = (np.frombuffer(v, np.uint64) if isinstance(v, bytes) else v for v in (x, y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def compared(texts: DataFrame, pairs: DataFrame, words: int, least: float, made, test) -> DataFrame:
    """The pairs (a, b) for which `test` of what `made` makes of their sets holds. That is dealt to blocks, and goes once to each
    pair of blocks where it is wanted, not once for each pair."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([made(own_set(t, words)) for t in batch.column("text")], pa.binary())], names=["key", "held"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, {}
        for batch in batches:
            keep = []
            for i, j, a, b, own in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "a", "b")), batch.column("held"), strict=True):
                if here != (i, j):
                    here, held = (i, j), {}
                if b is None:  # those of a pair of blocks come before its pairs
                    held[a] = own.as_py()
                keep.append(b is not None and test(held[a], held[b], least))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    n = pairs.count()
    if not n:
        return pairs
    pairs = gathered(pairs, n)
    named = pinned(gathered(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), 2 * n))
    m = named.count()
    some = texts.join(F.broadcast(named) if m <= FEW else named, "key", "left_semi")
    each = pinned(gathered(some.mapInArrow(members, "key long, held binary").groupBy("key").agg(F.first("held").alias("held")), m, SETS))
    blocks = max(8, math.ceil((each.agg(F.sum(F.octet_length("held"))).first()[0] or 0) / BLOCK_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = pairs.select(block("a").alias("i"), block("b").alias("j"), "a", "b")
    wanted = gathered(placed.select("i", "j", F.explode(F.array("a", "b")).alias("key")).distinct(), 2 * n)
    sent = gathered(wanted.join(each, "key"), 2 * n, SETS).select("i", "j", F.col("key").alias("a"), F.lit(None).cast("long").alias("b"), "held")
    both = sent.unionByName(placed.withColumn("held", F.lit(None).cast("binary")))
    met = gathered(both.repartition("i", "j"), 2 * n, SETS).sortWithinPartitions("i", "j", F.col("b").asc_nulls_first())
    return met.mapInArrow(compare, "a long, b long")


def alike(texts: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """texts: key, text. The pairs (a, b) whose sets are alike by `least`; those whose sketches forbid it are dropped first."""
    near_ones = pinned(compared(texts, pairs, words, least, sketch, sketches_near))
    return compared(texts, near_ones, words, least, np.ndarray.tobytes, sets_alike)


def roots_of(texts: DataFrame, words: int, least: float, bits: int, nearest: int) -> DataFrame:
    """texts: key, text. (key, root) of the texts that aren't the first of their component."""
    in_order = lambda rows: rows.repartition("value").sortWithinPartitions("value", "key")
    met = pinned(in_order(nodes(texts, words, least)).mapInArrow(shared_values, NODES))
    rows, links, tried, last = met.withColumn("root", F.col("key")), None, None, False
    while True:
        if last:
            new = pinned(crossing(texts, rows, words, least))
        else:
            found = rows.mapInArrow(lambda b: candidates(b, least, bits, nearest), "a long, b long").distinct()
            found = pinned(found if tried is None else found.join(tried, ["a", "b"], "left_anti"))
            found = gathered(found, found.count())
            new = pinned(alike(texts, found, words, least))
            tried = found if tried is None else tried.unionByName(found)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            roots = components(links).select(F.col("a").alias("key"), F.col("b").alias("root"))
            few = roots.count() <= FEW  # then the rows stay where they are, in order
            joined = met.join(F.broadcast(roots) if few else roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
            rows = joined if few else in_order(joined)
        if last:  # all that may be alike has been compared
            break
        last = new.isEmpty()
    if links is None:
        return texts.sparkSession.createDataFrame([], "key long, root long")
    return roots


def drop_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, bits: int = 30, nearest: int = 4) -> DataFrame:
    """The rows of docs, all columns, one of each component of texts alike by `least`: that of the least doc_id."""
    key = F.xxhash64(col(text_col))
    roots = roots_of(docs.select(key.alias("key"), col(text_col).alias("text")), words, least, bits, nearest)
    few = roots.count() <= FEW
    ids = docs.select(key.alias("key"), col(id_col).cast("long").alias("doc_id")).join(F.broadcast(roots) if few else roots, "key", "left")
    kept = ids.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), "key")).alias("it"), F.count(F.lit(1)).alias("n"))
    return rows_of(docs, key, id_col, kept.select("it.key", "it.id", "n"))
