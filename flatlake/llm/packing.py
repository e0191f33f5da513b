"""Best-fit packing of tokenised documents by non-negative least squares over length patterns.

1. Documents are tokenised in Spark tasks; those over `size` tokens are cut into pieces of `size`.
2. The histogram of piece lengths (at most `size` numbers) goes to the driver. Lengths are grouped in
   `UNITS` steps, all patterns of two or three steps that fill a sequence are enumerated, and
   non-negative least squares fits how often each pattern repeats. The counts are rounded down and
   filled with exact lengths; what is left is packed by best-fit decreasing, which also uses the room
   that patterns leave. All of it works on counts, so its cost depends on `size`, not on the rows.
3. The plan says, for each length, which ranks go to which sequences and offsets. Spark ranks the
   pieces of each length (numbering inside small groups plus the sizes of the groups before) and
   looks their places up. No row passes through the driver.

Defined results: null text is an empty document, which is the single id 0. Repeated rows are packed
each by itself. A null id is carried along. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, pinned
from .language_id import chunks

SIZE, UNITS, END = 2048, 64, 0


class Numbers(dict):
    """Numbers of words, in the order in which they are asked for first."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class WordTokenizer:
    """A tokenizer file's ids, with the ids of words kept: its model splits words one by one, so that a
    text's ids are those of its words in turn. Texts with characters beyond Latin letters, or with a
    special token's string, are encoded as a whole, and so are all texts if the file's normalizer, splitter or
    model isn't of the kind that WORDS knows."""

    #: Of a file: how texts are normalised and split into words, and what ends a word. WORDS holds for this alone.
    KIND = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"},
    }
    #: Words of that splitter, for the characters that PLAIN lets through.
    WORDS = re.compile(r"[a-zà-öø-ſßªº]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-zà-öø-ſßªº0-9]+")
    #: Code points that it takes as they are: ASCII and the Latin ones up to U+017F but for some odd ones.
    PLAIN = np.zeros(0x110000, bool)
    PLAIN[[9, 10, 13, *range(32, 127), *range(0xA1, 0x17F)]] = True
    PLAIN[[0xAD, 0xB2, 0xB3, 0xB4, 0xB5, 0xB9, 0xBC, 0xBD, 0xBE, 0x130, 0x149]] = False

    def __init__(self, path: str, most: int = 250_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        own = json.loads(self.tokenizer.to_str())
        parts = {k: own.get(k) for k in ("normalizer", "pre_tokenizer")} | {"model": {k: own["model"].get(k) for k in self.KIND["model"]}}
        self.by_words = parts == self.KIND
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._empty()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.at) > self.most:
            self._empty()
        known, split = len(self.at), list(map(self._numbers, texts))
        if len(self.at) > known:
            new = list(islice(reversed(self.at), len(self.at) - known))[::-1]
            rows = [" ".join(new[k : k + 500]) for k in range(0, len(new), 500)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for k in range(0, len(rows), 8) for e in self.tokenizer.encode_batch_fast(rows[k : k + 8], add_special_tokens=False)])
            self.start = np.concatenate([self.start, self.start[-1] + 1 + np.flatnonzero(self.ends[ids])])
            self.flat = np.concatenate([self.flat, ids])
        return [self._join(own) if own is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for own, t in zip(split, texts, strict=True)]

    def _numbers(self, text: str) -> np.ndarray | None:
        """The numbers of a text's words, new ones included; none for a text that has to be encoded as a whole."""
        low = text.lower() if self.by_words and self.is_plain(text) else None
        if low is None or any(s in low for s in self.special):
            return None
        words = self.WORDS.findall(low)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def is_plain(self, text: str) -> bool:
        return bool(self.PLAIN[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].all())

    def _empty(self) -> None:
        self.at = Numbers()  # a word's number; its ids are flat[start[number]:start[number + 1]]
        self.start, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _join(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return self.flat[:0]
        start, stop = self.start[at], self.start[at + 1]
        ends = np.cumsum(stop - start)
        return self.flat[np.arange(ends[-1]) + np.repeat(stop - ends, stop - start)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for rows in chunks(batches, 1_000_000):
            out: list[tuple] = []
            for doc, ids in zip(rows["doc_id"], encode([t or "" for t in rows["text"]]), strict=True):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    out.append((doc, k, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for _, v, t in zip(names, columns, kinds, strict=False)], names=names)

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with least |ax - b|: columns enter the active set by gradient, and leave it where they'd turn negative."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gradient = np.where(active, -np.inf, a.T @ (b - a @ x))
        if active.all() or gradient.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[gradient.argmax()] = True
        while True:
            want = np.zeros_like(x)
            want[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (want <= 0)
            if not low.any():
                break
            step = np.min(x[low] / (x[low] - want[low]))
            x += step * (want - x)
            active &= x > 1e-12
            x[~active] = 0
        x = want
    return x


@dataclass
class Plan:
    """Runs of alike sequences. Each use says: of `length`, ranks from `rank` on, `count` of them, go to
    sequences from `sequence` on, one each, at `offset`."""

    size: int
    left: np.ndarray  # pieces of each length still to place
    used: np.ndarray = field(init=False)
    sequences: int = 0
    uses: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, rank, count, sequence, offset
    rooms: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # by free tokens: first sequence, how many

    def __post_init__(self) -> None:
        self.used = np.zeros_like(self.left)

    def put(self, length: int, count: int, sequence: int, free: int) -> None:
        """count pieces of a length into as many sequences that each have `free` tokens left."""
        self.uses.append((length, int(self.used[length]), count, sequence, self.size - free))
        self.used[length] += count
        self.left[length] -= count

    def start(self, lengths: list[int], count: int) -> None:
        free = self.size
        for length in lengths:
            self.put(length, count, self.sequences, free)
            free -= length
        if free:
            self.rooms.setdefault(free, []).append((self.sequences, count))
        self.sequences += count

    def best_fit(self) -> None:
        """Longest pieces first, each into the fullest sequence that has room, or else a new one."""
        for length in range(self.size, 0, -1):
            for free in range(length, self.size):
                spots = self.rooms.get(free)
                while spots and self.left[length]:
                    sequence, n = spots.pop()
                    take = min(n, int(self.left[length]))
                    if take < n:
                        spots.append((sequence + take, n - take))
                    self.put(length, take, sequence, free)
                    if free > length:
                        self.rooms.setdefault(free - length, []).append((sequence, take))
                if not self.left[length]:
                    break
            alike = self.size // length
            if whole := int(self.left[length]) // alike:
                self._full(length, alike, whole)
            if rest := int(self.left[length]):
                self._full(length, rest, 1)

    def _full(self, length: int, each: int, count: int) -> None:
        """count sequences of `each` pieces of one length."""
        first, free = self.sequences, self.size
        for _ in range(each):
            self.put(length, count, first, free)
            free -= length
        if free:
            self.rooms.setdefault(free, []).append((first, count))
        self.sequences += count


def plan(counts: np.ndarray, size: int = SIZE, units: int = UNITS) -> Plan:
    """counts[n]: the number of pieces of n tokens, n up to size."""
    made = Plan(size, counts.astype(np.int64).copy())
    if made.left[size]:
        made.start([size], int(made.left[size]))
    step = -(-size // units)
    units = -(-size // step)
    bins = [range(k * step - step + 1, min(k * step, size) + 1) for k in range(1, units + 1)]  # lengths, rounded up to k steps
    total = np.array([made.left[b.start : b.stop].sum() for b in bins], float)
    patterns = [(k, m) for k in range(1, units) if (m := units - k) >= k]
    patterns += [(k, m, r) for k in range(1, units) for m in range(k, units) if (r := units - k - m) >= m]
    a = np.zeros((units, len(patterns)))
    for j, pattern in enumerate(patterns):
        np.add.at(a[:, j], np.array(pattern) - 1, 1)
    if patterns and total.any():
        for pattern, times in sorted(zip(patterns, np.floor(least_squares(a, total) + 1e-6).astype(int), strict=True)):
            while times > 0:  # the longest pieces of each step that are left, the last one as long as there is room
                lengths, free = [], size
                for k in sorted(pattern, reverse=True):
                    last = len(lengths) == len(pattern) - 1
                    longest = next((n for n in range(free if last else bins[k - 1].stop - 1, bins[k - 1].start - 1, -1) if made.left[n]), 0)
                    lengths.append(longest)
                    free -= longest
                if not all(lengths):
                    break
                need = {n: lengths.count(n) for n in lengths}
                if not (count := min(times, *(int(made.left[n]) // k for n, k in need.items()))):
                    break
                made.start(lengths, count)
                times -= count
    made.best_fit()
    return made


def place(rows: DataFrame, size: int = SIZE, group: int = 50_000) -> DataFrame:
    """rows with doc_id, piece, length (and more): sequence_id and offset are added."""
    n = rows.count()
    counts = np.zeros(size + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most `size` rows
        counts[r["length"]] = r["count"]
    uses = np.array(sorted(plan(counts, size).uses), np.int64).reshape(-1, 5)
    shared = rows.sparkSession.sparkContext.broadcast(uses)  # its size is bounded by the number of lengths
    # Ranks among the pieces of a length: numbered in groups of about `group`, plus the groups before.
    groups = max(1, min(n // 200, 1000), n // group)
    dealt = rows.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "__group").agg(F.count(F.lit(1)).alias("__n")).select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__group").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("__nth", F.row_number().over(inside)).join(sums, ["length", "__group"]).withColumn("__rank", F.col("__before") + F.col("__nth") - 1)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = shared.value
        # Ranks of one length follow each other in the plan; a length's own span makes the search one-dimensional.
        span = np.int64(uses[:, 1].max() + 1) if len(uses) else np.int64(1)
        keys = uses[:, 0] * span + uses[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1
            sequence, offset = uses[at, 3] + rank - uses[at, 1], uses[at, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = rows.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*names, "__rank").mapInArrow(look_up, schema)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids, the tokens themselves."""
    rows = pinned(pieces(docs, path, id_col, text_col, size, with_ids))
    return place(rows, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
