"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of `2 * Q` bytes that covers it also starts anywhere else. Suffixes are grouped
as in bucket-pointer refinement: a suffix's first bucket is named after its first Q bytes, and a bucket
is refined by sorting on the bucket names of its members' later offsets, here of offset Q, which gives
the order by 2Q bytes. Names are built the same way, from those of Q/4 bytes to Q/2 to Q, each from two
names of half the length, so the names at later offsets are reused on every level.

Not every suffix is shuffled. Of the Q + 1 suffixes from which a string of 2Q bytes holds the first Q, the
one with the least name is the string's anchor (about 2 in Q of all suffixes are one), so that a repeated
string has its anchor at the same place in each copy. The strings of one anchor follow each other; their
bytes together are the anchor's context, at most 3Q of them.

1. Anchors are bucketed by name. A bucket of one needs no refinement: none of its strings repeats.
2. Buckets of several are refined by the names of their contexts: where contexts are alike, all their
   strings repeat.
3. Where a bucket holds different contexts, mostly where a repeated stretch begins or ends, one of each is
   sent with its bytes, and the strings in them are refined by their names at offsets 0 and Q.

Skew: a task first groups what it has. It sends one row for each of its buckets or contexts, and what it
has found to repeat needs no answer, so that a bucket with a third of all rows arrives as a row per task
and block; groups are read as sorted streams, never gathered. Only step 3 gathers buckets; those of over
`HEAVY` different contexts are sent as single strings instead, by their own names. Names have 64 bits;
contexts and strings are told apart by two of them.

Defined results: null text is empty. Repeated rows are separate documents that repeat each other; a null
id is carried along. An empty table gives an empty result. Other columns are ignored, whatever their
names. The input must give the same rows in the same partitions when read again, as files do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, pinned

Q = 100
#: Bytes named at once; longer texts are cut into overlapping blocks.
BLOCK = 1_000_000
#: Anchors or suffixes that a task groups before it sends them.
TOGETHER = 500_000
#: Different contexts of one bucket that a task compares.
HEAVY = 2000
#: Buckets of more contexts that are broadcast, at most; beyond, they are joined by a shuffle.
FEW = 1_000_000
#: What a row of names needs: whether others have its first name, its both names, or nothing, as it is known to repeat. Or
#: it only tells of what its task has: a bucket of one context, a bucket of several, a context, a context in a bucket of several.
BUCKET, STRING, KNOWN, TELL_BUCKET, TELL_MIXED, TELL_STRING, MIXED_STRING, TELL_MIXED_STRING = range(8)
#: Of an anchor's place, the bits for how far before it its first string begins, and for the number of its strings.
BACK, COUNT = 7, 7

_rng = np.random.default_rng(20240607)
LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
STIR = np.uint64(0xD6E8FEB86659FD93)


def stirred(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= STIR
    x ^= x >> np.uint64(29)
    x *= BASE
    x ^= x >> np.uint64(32)
    return x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE ** k and its inverse modulo 2 ** 64, for k under n."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        for k, base in enumerate((BASE, inverse)):
            _powers[k] = np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]).cumprod(dtype=np.uint64)
    return [p[:n] for p in _powers]


def names(data: np.ndarray) -> np.ndarray:
    """The bucket name of the Q bytes from each place on; one per place that has as many."""
    n, q = len(data) - Q + 1, Q // 4
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTER[data] * up[:-1], out=sums[1:])
    name = stirred((sums[q:] - sums[:-q]) * down[: len(data) - q + 1])
    while q < Q:
        name = stirred(name[:-q] * LETTER[q] + name[q:])
        q *= 2
    return name


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(values) - width + 1
    whole = -(-len(values) // width) * width
    padded = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def blocks(starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Cuts texts, given their starts in one buffer, into (first text, last text + 1, from, to, strings that
    begin before): neighbours together up to BLOCK bytes, long ones by themselves in overlapping blocks."""
    k, n = 0, len(starts) - 1
    while k < n:
        if starts[k + 1] - starts[k] > BLOCK:
            for at in range(int(starts[k]), int(starts[k + 1]), BLOCK):
                yield k, k + 1, at, min(at + BLOCK + 3 * Q, int(starts[k + 1])), min(at + BLOCK, int(starts[k + 1]))
            k += 1
        else:
            stop = max(k + 1, int(np.searchsorted(starts, starts[k] + BLOCK, "right")) - 1)
            yield k, stop, int(starts[k]), int(starts[stop]), int(starts[stop])
            k = stop


def named(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For the blocks of texts in one buffer: first text, last + 1, where the block begins, the names in it, the
    strings of 2Q bytes that begin in it (and end in their text), and the anchor of each: its least name."""
    low = np.uint64(2**31 - 1)
    for first, stop, begin, end, limit in blocks(starts):
        name = names(data[begin:end])
        if len(name) <= Q:
            continue
        anchor = (least((name & ~low) | np.arange(len(name), dtype=np.uint64), Q + 1) & low).astype(np.int64)
        whole = np.ones(len(anchor), bool)
        for e in starts[first + 1 : stop] - begin:
            whole[max(0, e - 2 * Q + 1) : e] = False
        whole[max(0, limit - begin) :] = False
        string = np.flatnonzero(whole)
        yield first, stop, begin, name, string, anchor[string]


def packed(place: np.ndarray, back: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (place << BACK | back) << COUNT | count


def unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> (BACK + COUNT), (x >> COUNT) & (2**BACK - 1), x & (2**COUNT - 1)


def anchors(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For texts in one buffer, the anchors: (text, packed place in it, name, name of the context)."""
    for first, stop, begin, name, string, anchor in named(data, starts):
        if not len(string):
            continue
        run = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        at, start, count = anchor[run], string[run], np.diff(np.append(run, len(string)))
        text = first + np.searchsorted(starts[first + 1 : stop + 1] - begin, at, "right")
        shape = ((at - start) << COUNT | count).astype(np.uint64)
        # Names at a context's start, Q later and Q before its end have all of its 2Q to 3Q bytes.
        context = stirred(stirred(stirred(name[start] + shape) + name[start + Q]) * STIR + name[start + count - 1 + Q])
        yield text, packed(at + begin - starts[text], at - start, count), name[at], context


def fates(first: np.ndarray, second: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Groups what a task has by both names, and these groups by the first. Returns (rows, what they need)."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new = new_a | np.concatenate([[True], b[1:] != b[:-1]])
    alone = new & np.concatenate([new[1:], [True]])
    bucket = np.cumsum(new_a) - 1
    mixed = (np.bincount(bucket[new]) > 1)[bucket]
    return [
        (order[~alone], KNOWN),
        (order[alone & ~mixed], BUCKET),
        (order[new & ~alone & ~mixed], TELL_BUCKET),
        (order[new & ~alone & ~mixed], TELL_STRING),
        (order[new_a & mixed], TELL_MIXED),
        (order[alone & mixed], MIXED_STRING),
        (order[new & ~alone & mixed], TELL_MIXED_STRING),
    ]


ROW = "first long, second long, rid long, place long, need int"
#: By bucket, by both names, or, where no answer is needed, anywhere.
ROUTE = f"CASE WHEN need IN ({BUCKET}, {TELL_BUCKET}, {TELL_MIXED}) THEN first WHEN need = {KNOWN} THEN xxhash64(rid, place) ELSE xxhash64(first, second) END"
KIND = f"CASE WHEN need IN ({BUCKET}, {TELL_BUCKET}, {TELL_MIXED}) THEN 0 WHEN need = {KNOWN} THEN 1 ELSE 2 END"


def batch_of(first: np.ndarray, second: np.ndarray, rid: np.ndarray, place: np.ndarray, need: np.ndarray | int) -> pa.RecordBatch:
    need = np.broadcast_to(np.asarray(need, np.int32), first.shape)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (first.view(np.int64), second.view(np.int64), rid, place, need.copy())], names=["first", "second", "rid", "place", "need"])


def sent(rid: np.ndarray, place: np.ndarray, first: np.ndarray, second: np.ndarray) -> Iterator[pa.RecordBatch]:
    for rows, need in fates(first, second):
        if len(rows):
            yield batch_of(first[rows], second[rows], rid[rows], place[rows], need)


def buffers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, and where each starts."""
    text = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        rid = batch.column("rid").to_numpy()
        for text, place, a, b in anchors(*buffers(batch)):
            held.append((rid[text], place, a, b))
            if sum(len(h[0]) for h in held) >= TOGETHER:
                yield from sent(*joined(held))
                held = []
    if held:
        yield from sent(*joined(held))


Rows = dict[str, np.ndarray]


KINDS = np.array([0, 2, 1, 0, 0, 2, 2, 2])


def beside(rows: Rows, before: Rows | None, after: Rows | None) -> tuple[tuple[Rows, np.ndarray, np.ndarray], ...]:
    """For the row before and the row after each: those rows, whether kind and first name are equal, and the second too."""
    none = {c: np.zeros(1, v.dtype) for c, v in rows.items()}
    ends = [{c: v[-1:] for c, v in before.items()} if before else none, {c: v[:1] for c, v in after.items()} if after else none]
    out = []
    for k, (end, there) in enumerate(zip(ends, (before, after), strict=True)):
        other = {c: np.concatenate([end[c], v[:-1]] if k == 0 else [v[1:], end[c]]) for c, v in rows.items()}
        same = (other["first"] == rows["first"]) & (KINDS[other["need"]] == KINDS[rows["need"]])
        if not there:
            same[0 if k == 0 else -1] = False
        out.append((other, same, same & (other["second"] == rows["second"])))
    return tuple(out)


def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Rows, tuple]]:
    """Rows sorted by kind and names, with their neighbours."""
    before = rows = None
    for batch in batches:
        if batch.num_rows:
            after = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            if rows is not None:
                yield rows, beside(rows, before, after)
            before, rows = rows, after
    if rows is not None:
        yield rows, beside(rows, before, None)


def settle_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows alone in their bucket end here; the others go on to ask by context, with what they know of the bucket."""
    for rows, sides in neighbours(batches):
        shared = np.logical_or.reduce([same for _, same, _ in sides])
        mixed = np.logical_or.reduce([same & (~alike | (other["need"] == TELL_MIXED)) for other, same, alike in sides])
        need = rows["need"].copy()
        asks, tells = rows["need"] == BUCKET, rows["need"] == TELL_BUCKET
        need[asks] = np.where(mixed, MIXED_STRING, STRING)[asks]
        need[tells] = TELL_MIXED_STRING
        go = np.where(asks, shared, np.where(tells, mixed, rows["need"] != TELL_MIXED))
        if go.any():
            yield batch_of(*(rows[c][go] for c in ("first", "second", "rid", "place")), need[go])


#: Of a mark, under the packed place: it is known to repeat; its context is to be sent.
REPEATS, SEND = 1, 2


def settle_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the anchors whose contexts repeat or have to be sent. Rows of one context come with the largest need first."""
    for rows, ((_, _, follows), (_, _, leads)) in neighbours(batches):
        need = rows["need"]
        asks, tells = (need == STRING) | (need == MIXED_STRING), (need == TELL_STRING) | (need == TELL_MIXED_STRING)
        several = follows | leads | tells
        speaks = ~follows & several & ((need == MIXED_STRING) | (need == TELL_MIXED_STRING))  # one for each context of a bucket of several
        mark = np.where((need == KNOWN) | (asks & several) | speaks, REPEATS, 0) | np.where(speaks | (asks & ~several), SEND, 0)
        go = mark > 0
        if go.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[go]) for x in (rows["first"], rows["rid"], rows["place"] << 2 | mark)], names=["bucket", "rid", "mark"])


SENT = "heavy boolean, first long, second long, rid long, place long, need int, context binary"
STRING_NEEDS = {KNOWN: KNOWN, BUCKET: STRING, MIXED_STRING: STRING, TELL_STRING: TELL_STRING, TELL_MIXED_STRING: TELL_STRING}


def strings_of(data: np.ndarray, starts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """For contexts in one buffer: (context, string's place in its text, its two names)."""
    at, back, count = unpacked(place)
    name = names(data)
    ends = np.cumsum(count)
    which = np.repeat(np.arange(len(count)), count)
    nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
    where = starts[which] + nth
    return which, at[which] - back[which] + nth, name[where], name[where + Q]


def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts with their bytes, or, for buckets of very many, their strings' names."""
    for batch in batches:
        data, starts = buffers(batch)
        rids, marks = batch.column("rid").to_numpy(), batch.column("marks")
        flat = marks.flatten()
        text = np.repeat(np.arange(batch.num_rows), marks.value_lengths().to_numpy())
        mark, bucket, heavy = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("mark", "bucket", "heavy"))
        place, rid = mark >> 2, rids[text]
        at, back, count = unpacked(place)
        start = starts[text] + at - back
        stop = start + count - 1 + 2 * Q
        if (light := np.flatnonzero(~heavy)).size:
            context = pa.array([data[a:b].tobytes() for a, b in zip(start[light], stop[light], strict=True)], pa.binary())
            asks = np.where(mark[light] & REPEATS, TELL_STRING, STRING).astype(np.int32)
            yield sent_batch(False, bucket[light], np.zeros(len(light), np.int64), rid[light], place[light], asks, context)
        many = np.flatnonzero(heavy)
        for k in range(0, len(many), 10_000):
            part = many[k : k + 10_000]
            ends = np.cumsum(stop[part] - start[part])
            own = np.concatenate([data[a:b] for a, b in zip(start[part], stop[part], strict=True)])
            which, where, a, b = strings_of(own, ends - (stop[part] - start[part]), place[part])
            for rows, need in fates(a, b):
                if need in STRING_NEEDS and len(rows):
                    yield sent_batch(True, a[rows].view(np.int64), b[rows].view(np.int64), rid[part][which[rows]], packed(where[rows], 0 * rows, 0 * rows + 1), np.full(len(rows), STRING_NEEDS[need], np.int32), pa.nulls(len(rows), pa.binary()))


def sent_batch(heavy: bool, first: np.ndarray, second: np.ndarray, rid: np.ndarray, place: np.ndarray, need: np.ndarray, context: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rid), heavy)), *(pa.array(x) for x in (first, second, rid, place, need)), context], names=[c.split()[0] for c in SENT.split(", ")])


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that rows of equal keys come together. For groups of bounded size."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        same = np.logical_and.reduce([(v := batch.column(k).to_numpy(zero_copy_only=False)) == v[-1] for k in keys])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield batch.slice(0, cut)
        rest = batch.slice(cut)
    if rest is not None:
        yield rest


def runs_of(rid: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(place << COUNT | 1)], names=["rid", "run"])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, run) of the strings that repeat, as place << COUNT | number of strings from there on."""
    for batch in whole_groups(batches, ["heavy", "first"]):
        heavy, need = batch.column("heavy").to_numpy(zero_copy_only=False), batch.column("need").to_numpy()
        rid, place, first, second = (batch.column(c).to_numpy() for c in ("rid", "place", "first", "second"))
        if (many := np.flatnonzero(heavy)).size:
            a, b, n = first[many], second[many], need[many]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (n[1:] != KNOWN) & (n[:-1] != KNOWN)
            shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            go = many[(n == KNOWN) | ((n == STRING) & shared)]
            yield runs_of(rid[go], unpacked(place[go])[0])
        light = np.flatnonzero(~heavy)
        edges = np.flatnonzero(np.diff(first[light])) + 1
        # Whole buckets, about 5000 contexts at a time.
        for part in np.split(light, edges[np.flatnonzero(np.diff(edges // 5000, prepend=0))]):
            if not len(part):
                continue
            context = batch.column("context").take(pa.array(part)).cast(pa.large_binary())
            offsets = np.frombuffer(context.buffers()[1], np.int64)[: len(part) + 1]
            which, where, a, b = strings_of(np.frombuffer(context.buffers()[2], np.uint8), offsets, place[part])
            bucket = first[part][which]
            order = np.lexsort((b, a, bucket))
            same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (bucket, a, b)])
            shared = np.zeros(len(order), bool)
            shared[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            go = shared & (need[part] == STRING)[which]
            yield runs_of(rid[part][which[go]], where[go])


def cover(n: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (from, to) of the bytes that the strings cover."""
    runs = np.unique(runs)
    start, stop = runs >> COUNT, np.maximum.accumulate((runs >> COUNT) + (runs & (2**COUNT - 1)) - 1 + 2 * Q)
    apart = np.flatnonzero(start[1:] > stop[:-1])
    return start[np.concatenate([[0], apart + 1])], np.minimum(stop[np.concatenate([apart, [len(stop) - 1]])], n)


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = buffers(batch)
        marks, out = batch.column("marks"), []
        for k in range(batch.num_rows):
            own, spans, removed = data[starts[k] : starts[k + 1]], [], 0
            kept = hashlib.sha256()
            if marks[k].is_valid:
                at = 0
                for a, b in zip(*cover(len(own), marks[k].values.to_numpy()), strict=True):
                    kept.update(own[at:a])
                    spans.append({"start": int(a), "length": int(b - a)})
                    removed += int(b - a)
                    at = b
                own = own[at:]
            kept.update(own)
            out.append((int(starts[k + 1] - starts[k]), removed, len(spans), kept.hexdigest(), spans))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
        columns = [pa.array(list(v), t) for v, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans, the removed (start, length) in bytes."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    asked = rows.select("rid", "text").mapInArrow(find_anchors, ROW)
    by_bucket = asked.repartition(F.expr(ROUTE)).sortWithinPartitions(F.expr(KIND), "first", "second")
    by_context = by_bucket.mapInArrow(settle_buckets, ROW).repartition(F.expr(ROUTE)).sortWithinPartitions(F.expr(KIND), "first", "second", F.desc("need"))
    found = pinned(by_context.mapInArrow(settle_contexts, "bucket long, rid long, mark long"))
    send = found.filter(F.col("mark").bitwiseAND(SEND) > 0)
    many = pinned(send.groupBy("bucket").count().filter(F.col("count") > HEAVY).select("bucket", F.lit(True).alias("heavy")))
    few = many.count() <= FEW  # then rows of a common bucket stay where they are
    flagged = send.join(F.broadcast(many) if few else many, "bucket", "left").select("rid", F.struct("mark", "bucket", F.coalesce("heavy", F.lit(False)).alias("heavy")).alias("m"))
    marks = flagged.groupBy("rid").agg(F.collect_list("m").alias("marks"))
    contexts = rows.join(marks, "rid").mapInArrow(send_contexts, SENT)
    target = F.when(F.col("heavy"), F.xxhash64("first", "second")).otherwise(F.col("first"))
    edges = contexts.repartition(target).sortWithinPartitions("heavy", "first", "second").mapInArrow(compare, "rid long, run long")
    place = F.shiftright("mark", 2)
    start = F.shiftright(place, BACK + COUNT) - F.shiftright(place, COUNT).bitwiseAND(2**BACK - 1)
    known = found.filter(F.col("mark").bitwiseAND(REPEATS) > 0).select("rid", F.shiftleft(start, COUNT).bitwiseOR(place.bitwiseAND(2**COUNT - 1)).alias("run"))
    covered = known.unionByName(edges).groupBy("rid").agg(F.collect_list("run").alias("marks"))
    kept = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, length: long>>"
    return rows.join(covered, "rid", "left").select("doc_id", "text", "marks").mapInArrow(remove, kept)
