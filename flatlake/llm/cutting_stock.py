"""Packing of tokenised documents as a cutting-stock problem, solved by column generation.

1. Documents are tokenised once, in Spark tasks; ids, lengths and checksums are written to the shared folder.
2. The histogram of lengths up to `size` goes to the driver, `size` numbers. Lengths are classes of size / UNITS tokens,
   rounded up. A linear program covers all classes by patterns (how many of each class share a sequence) with as few
   sequences as can be: the simplex method holds one pattern for each class, the dual prices of the classes are given to a
   knapsack, solved by dynamic programming over the UNITS of a sequence, and the pattern that it finds enters, until none
   is worth more than a sequence.
3. Patterns are used as often as the program says, rounded down, and filled with exact lengths, of which the last two are
   chosen to leave the least room; then the program is solved again for what is left, as long as that places a tenth of
   it. What documents are left in the end, and those over `size`, are laid end to end and cut: into the rooms
   that patterns left, then into whole sequences, and the rest into powers of two, which need no padding. So nothing is
   padded. If that line is shorter than all rooms, the sequences with the largest rooms are taken apart and join it.
4. The plan says, for each length, which ranks go to which sequences and offsets, and for the line, which stretches. Spark
   ranks the documents of each length and sums the lengths along the line, in groups and then over the groups, and looks
   places up. No row passes through the driver, and the plan's size depends on `size` alone.

Defined results: null text is an empty document, which is the single id 2. Repeated rows are packed each by itself. A
null id is carried along. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh_path, pinned
from .language_id import chunks
from .packing import tokenizer

SIZE, UNITS, END = 4096, 128, 2


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Per document: doc_id, doc_tokens, ids_crc32 and ids, as little-endian numbers of two bytes each (four, if the
    tokenizer has more ids than that)."""
    names = ["doc_id", "doc_tokens", "ids_crc32", "ids"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        kind = "<u2" if len(encode.ends) <= 1 << 16 else "<u4"
        for rows in chunks(batches, 1_000_000):
            ids = [np.append(i, np.uint32(end)).astype("<u4") for i in encode([t or "" for t in rows["text"]])]
            columns = [pa.array(rows["doc_id"], pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([i.astype(kind).tobytes() for i in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(encoded, "doc_id long, doc_tokens long, ids_crc32 long, ids binary")


def knapsack(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """How many of each item, of sizes 1, 2, ... and any number of each, are worth most within room. A value of -inf: no such item."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, int)
    for c in range(1, room + 1):
        with_item = best[c - 1 :: -1][: len(values)] + values[: c]
        k = int(with_item.argmax())
        best[c], last[c] = (with_item[k], k + 1) if with_item[k] > best[c - 1] else (best[c - 1], 0)
    counts, c = np.zeros(len(values), int), room
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
        c -= max(1, last[c])
    return float(best[room]), counts


def inverse_of(a: np.ndarray) -> np.ndarray:
    """By elimination. The matrices are small, and calls that start threads of their own cost more than they save."""
    n = len(a)
    both = np.hstack([a.astype(float), np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        others = np.arange(n) != k
        both[others] -= np.outer(both[others, k], both[k])
    return both[:, n:]


def column_generation(demand: np.ndarray, room: int, rounds: int = 20_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, fractions too, so that demand[k] items of size k + 1 are covered by the fewest
    bins of `room`. A basic solution: no more patterns than sizes."""
    wanted = np.flatnonzero(demand)
    n = len(wanted)
    if not n:
        return []
    columns = np.diag((room // (wanted + 1)).astype(float))  # one pattern for each size: as many as fit
    inverse = np.diag(1 / columns.diagonal())
    amounts = demand[wanted].astype(float) * (1 + 1e-9 * np.arange(n) / n)  # apart, so that no two rows leave at once
    for turn in range(rounds):
        if turn % 100 == 99:
            inverse = inverse_of(columns)
        prices = np.full(room, -np.inf)
        prices[wanted] = inverse.sum(axis=0)  # of each size, in bins
        worth, pattern = knapsack(prices, room)
        if worth <= 1 + 1e-9:
            break
        step, left = (inverse * pattern[wanted]).sum(axis=1), (inverse * amounts).sum(axis=1)
        ratios = np.where(step > 1e-9, left / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratios.argmin())
        columns[:, out] = pattern[wanted]
        inverse[out] /= step[out]
        others = np.arange(n) != out
        inverse[others] -= np.outer(step[others], inverse[out])
    used = (inverse_of(columns) * demand[wanted]).sum(axis=1)
    out = []
    for j in np.flatnonzero(used > 1e-9):
        pattern = np.zeros(room, int)
        pattern[wanted] = np.rint(columns[:, j]).astype(int)
        out.append((pattern, float(used[j])))
    return out


@dataclass
class Plan:
    """runs: the lengths in a sequence, and how many such sequences. From them: uses (length, first rank, count, first
    sequence, offset), and cells of the line (first position, size, first sequence, offset, count)."""

    size: int
    left: np.ndarray  # documents of each length that no run has
    line: int  # tokens of the documents over `size`
    runs: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    def fill(self, classes: list[range], times: int) -> None:
        """Sequences of one document from each class, of exact lengths that leave little room."""
        while times > 0 and (lengths := self._lengths(classes)):
            count = min(times, *(int(self.left[n]) // lengths.count(n) for n in set(lengths)))
            if not count:  # too few of a length for one sequence
                break
            for n in lengths:
                self.left[n] -= count
            self.runs.append((tuple(lengths), count))
            times -= count

    def _lengths(self, classes: list[range]) -> list[int]:
        """The longest of each class but for two, and two that together leave the least room; nothing if a class has none."""
        lengths, left = [], self.left.copy()
        for own in classes[: max(1, len(classes) - 2)]:
            there = np.flatnonzero(left[own.start : own.stop])
            if not len(there):
                return []
            lengths.append(own.start + int(there[-1]))
            left[lengths[-1]] -= 1
        free = self.size - sum(lengths)
        if len(classes) < 3:  # the only one, or the first of two
            lengths, left, free = lengths[: len(classes) == 1], self.left, self.size
        if len(classes) == 1:
            return lengths
        own = np.arange(classes[-2].start, min(classes[-2].stop, free))
        own = own[left[own] > 0]
        for room in range(free):
            other = np.maximum(free - room - own, 0)
            fits = (other > 0) & (left[other] > (other == own))
            if fits.any():
                best = int(np.where(fits, np.minimum(left[own], left[other]), -1).argmax())
                return [*lengths, int(own[best]), int(other[best])]
        return []

    def close(self) -> None:
        """Takes runs apart until the line fills all rooms, and numbers the sequences."""
        room = lambda lengths: self.size - sum(lengths)
        self.runs.sort(key=lambda run: (room(run[0]), run[0]))
        total = int(self.left @ np.arange(self.size + 1)) + self.line
        rooms = sum(room(lengths) * count for lengths, count in self.runs)
        while rooms > total:
            lengths, count = self.runs.pop()
            apart = min(count, -(-(rooms - total) // self.size))  # each gives its tokens to the line and takes its room away
            for n in lengths:
                self.left[n] += apart
            total, rooms = total + apart * sum(lengths), rooms - apart * room(lengths)
            if count > apart:
                self.runs.append((lengths, count - apart))
        used, self.uses, self.cells, self.sequences, at = np.zeros_like(self.left), [], [], 0, 0
        for lengths, count in self.runs:
            offset = 0
            for n in lengths:
                self.uses.append((n, int(used[n]), count, self.sequences, offset))
                used[n] += count
                offset += n
            if offset < self.size:
                self.cells.append((at, self.size - offset, self.sequences, offset, count))
                at += (self.size - offset) * count
            self.sequences += count
        self.used = used
        for size in [self.size, *(1 << b for b in range(self.size.bit_length() - 1, -1, -1))]:
            if count := (total - at) // size:
                self.cells.append((at, size, self.sequences, 0, count))
                self.sequences += count
                at += size * count


def plan(counts: np.ndarray, line: int, size: int = SIZE, units: int = UNITS) -> Plan:
    """counts[n]: documents of n tokens, n up to size; line: the tokens of all longer ones."""
    made = Plan(size, counts.astype(np.int64).copy(), line)
    step = -(-size // units)
    units = size // step  # a class's documents and a pattern's classes, rounded up, fit in a sequence
    classes = [range(k * step - step + 1, (k * step if k < units else size) + 1) for k in range(1, units + 1)]
    before = np.inf
    while (left := int(made.left.sum())) < 0.9 * before:  # again for what rounding, and lengths that others took, have left
        demand, before = np.array([made.left[c.start : c.stop].sum() for c in classes]), left
        for pattern, times in sorted(column_generation(demand, units), key=lambda p: -p[1]):
            made.fill([classes[k] for k in range(units - 1, -1, -1) for _ in range(pattern[k])], int(times + 1e-6))
    made.close()
    return made


def _ranked(rows: DataFrame, groups: int, by: list[str], amount: str, name: str) -> DataFrame:
    """rows with the sum of `amount` over the rows before, of those alike in `by`: along a hash group, plus the groups before."""
    dealt = rows.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    before = Window.partitionBy(*by).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "__group").agg(F.sum(amount).alias("__sum")).select(*by, "__group", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__group").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("__within", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return within.join(sums, [*by, "__group"]).withColumn(name, F.col("__before") + F.col("__within")).drop("__group", "__within", "__before")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, units: int = UNITS, with_ids: bool = False, group: int = 50_000, most: int = 100_000) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids. `most` rows of
    short documents on the line, at most, are broadcast to find their ids."""
    spark, folder = docs.sparkSession, fresh_path(docs.sparkSession, "tokens")
    tokenised(docs, path, id_col, text_col).withColumn("__row", F.monotonically_increasing_id()).write.parquet(folder)
    tokens = spark.read.schema("doc_id long, doc_tokens long, ids_crc32 long, ids binary, __row long").parquet(folder)
    counts, line, n = np.zeros(size + 1, np.int64), 0, 0
    short = F.least("doc_tokens", F.lit(size + 1))
    for r in tokens.groupBy(short.alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.sum("doc_tokens").alias("tokens")).collect():  # size + 1 rows at most
        n += r["rows"]
        if r["n"] <= size:
            counts[r["n"]] = r["rows"]
        else:
            line = r["tokens"]
    made = plan(counts, line, size, units)
    shared = spark.sparkContext.broadcast((np.array(sorted(made.uses), np.int64).reshape(-1, 5), np.array(made.cells, np.int64).reshape(-1, 5), made.used))
    groups = max(1, min(n // 200, 1000), n // group)
    ids = ["ids"] * with_ids
    ranked = tokens.filter(F.col("doc_tokens") <= size).select("doc_id", "doc_tokens", "ids_crc32", "__row", *ids).withColumn("__one", F.lit(1))
    ranked = pinned(_ranked(ranked, groups, ["doc_tokens"], "__one", "__rank"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *ids]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    numbers = lambda own, length: np.frombuffer(own, f"<u{len(own) // length}")
    listed = lambda values: pa.array(values, pa.list_(pa.int32()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, _, used = shared.value
        span = np.int64(uses[:, 1].max() + 1) if len(uses) else np.int64(1)
        keys = uses[:, 0] * span + uses[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_tokens", "__rank"))
            own = np.flatnonzero(rank < used[length])
            length, rank, batch = length[own], rank[own], batch.take(pa.array(own))
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            columns = [batch.column("doc_id"), pa.array(np.zeros_like(length)), pa.array(length), batch.column("ids_crc32"), pa.array(length), pa.array(uses[at, 3] + rank - uses[at, 1]), pa.array(uses[at, 4])]
            more = [listed([numbers(i, k).astype(np.int32) for i, k in zip(batch.column("ids").to_pylist(), length, strict=True)])] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns + more, names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value[1]
        for batch in batches:
            out = []
            for doc, n, own, first in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "__first")), strict=True):
                own, start = numbers(own, n), 0
                run = int(np.searchsorted(cells[:, 0], first, "right")) - 1
                while start < n:
                    begin, room, sequence, offset, count = map(int, cells[run])
                    nth, inside = divmod(first + start - begin, room)
                    if nth >= count:
                        run += 1
                        continue
                    length = min(n - start, room - inside)
                    part = own[start : start + length].astype("<u4")
                    out.append((doc, start, length, zlib.crc32(part), n, sequence + nth, offset + inside, part.astype(np.int32))[: len(names)])
                    start += length
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns[:7]] + [listed(list(v)) for v in columns[7:]], names=names)

    whole = ranked.mapInArrow(placed, schema)
    # The line: the documents over `size`, which are cut anyway, and behind them the short ones that the plan left.
    used = spark.createDataFrame([(k, int(v)) for k, v in enumerate(made.used)], "doc_tokens long, __used long")  # size + 1 rows
    late = ranked.join(F.broadcast(used), "doc_tokens").filter("__rank >= __used").select("__row", "doc_tokens", F.lit(1).alias("__late"))
    long = tokens.filter(F.col("doc_tokens") > size)
    on_line = long.select("__row", "doc_tokens", F.lit(0).alias("__late")).unionByName(late)
    summed = _ranked(on_line, groups, ["__late"], "doc_tokens", "__first")
    first_late = pinned(summed.select("__row", F.when(F.col("__late") == 1, F.col("__first") + line).otherwise(F.col("__first")).alias("__first"), "__late"))
    places = first_late.filter("__late = 1").drop("__late")
    few = int(made.left.sum()) <= most
    short_ids = tokens.filter(F.col("doc_tokens") <= size).join(F.broadcast(places) if few else places, "__row")
    long_ids = long.join(first_late.filter("__late = 0").drop("__late"), "__row")
    cols = ["doc_id", "doc_tokens", "ids", "__first"]
    return whole.unionByName(long_ids.select(*cols).unionByName(short_ids.select(*cols)).mapInArrow(cut, schema))
