"""Language identification by rank-order n-gram profiles.

A profile is a language's most frequent n-grams of one to three letters, in rank order. A document is
ranked the same way over its whole text and goes to the language whose profile has the smallest
out-of-place distance: the sum of rank differences, an n-gram that the profile lacks counting as the
whole profile's length. Non-letters separate words; words are padded with a blank.

Profiles are counted over all training texts (partial sums per task, then one Spark aggregation), and
only `languages x size` ranked n-grams reach the driver; more than `max_languages` languages raise.

Defined results: null texts and texts without a letter get `und` and score 0, as do all texts when
nothing was learned. Equal distances go to the language first in code point order; equal n-gram
counts rank in code point order. Rows are judged one by one, so repeated rows get equal results. An
empty table gives an empty result; columns that aren't named are ignored. A null id is never trained
on: it counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

SPACE, BITS, WIDTH = 32, 21, 0x110000
UNKNOWN = "und"
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter. Built once a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(WIDTH)), bool, WIDTH)
    return _letters


def grams(text: str) -> np.ndarray:
    """The n-grams (n from 1 to 3) of the words of a text, each as one integer, or none."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes = np.where(letters()[codes], codes, SPACE)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    codes = codes[keep]
    if len(codes) < 3:
        return codes[:0]
    word = codes != SPACE
    two = codes[:-1] << BITS | codes[1:]
    three = codes[:-2] << 2 * BITS | two[1:]
    return np.concatenate([codes[word], two, three[word[1:-1]]])


def ranked(text: str, size: int) -> np.ndarray:
    found, counts = np.unique(grams(text), return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:size]]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = 500_000) -> Iterator[dict[str, list]]:
    """Rows as column lists, cut so that a chunk's texts have about `limit` characters at most, or one text."""
    for batch in batches:
        rows, texts = batch.to_pydict(), batch.column("text")
        sizes = np.cumsum([len(t) if t is not None else 0 for t in rows["text"]]) if len(texts) else []
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield {k: v[start:stop] for k, v in rows.items()}
            start = stop


@dataclass
class Profiles:
    """names: the languages in order; known: all profile n-grams, sorted; rank: of each, by language."""

    names: list[str]
    known: np.ndarray
    rank: np.ndarray
    size: int

    def judge(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.size) if text and self.names else ()
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        ranks = np.where(self.known[at] == own, self.rank[:, at], self.size)
        off = np.where(ranks < self.size, np.abs(ranks - np.arange(len(own))), self.size).sum(axis=1)
        best = int(np.argmin(off))
        return self.names[best], float(1 - off[best] / (self.size * len(own)))


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", size: int = 300, max_languages: int = 1000) -> Profiles:
    """Profiles from the rows of docs where `usable` holds and language and text are not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            by_lang: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(rows["text"], rows["lang"], strict=True):
                by_lang.setdefault(lang, []).append(grams(text))
            for lang, found in by_lang.items():
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": gram, "n": n})

    rows = docs.filter(usable).select(col(text_col).alias("text"), col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).filter(F.col("place") <= size).select("lang", "gram", "place").limit(size * max_languages + 1).toPandas()
    if len(top) > size * max_languages:
        raise ValueError(f"over {max_languages} languages in {lang_col}")
    names = sorted(top["lang"].unique())
    known, at = np.unique(top["gram"].to_numpy(np.int64), return_inverse=True)
    rank = np.full((len(names), len(known)), size, np.int32)
    rank[np.searchsorted(np.array(names, object), top["lang"].to_numpy(object)) if names else [], at] = top["place"].to_numpy(np.int32) - 1
    return Profiles(names, known, rank, size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs, all columns, with lang_pred and lang_score appended as __lang_pred and __lang_score."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("pred string, score double")
    def judged(texts: pa.Array) -> pa.Array:
        # Some texts at a time, so that few of them are there as Python's own at once.
        found = [shared.value.judge(t) for k in range(0, len(texts), 200) for t in texts.slice(k, 200).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["pred", "score"])

    # Not deterministic for Spark, so that a filter on the result doesn't have each text judged once more.
    both = docs.withColumn("__judged", judged.asNondeterministic()(col(text_col)))
    return both.withColumns({"__lang_pred": F.col("__judged.pred"), "__lang_score": F.col("__judged.score")}).drop("__judged")


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(True))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    aside = held_out(col(id_col))
    profiles = train(docs, ~aside, text_col, lang_col)
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), aside.alias("held_out"))
    return identify(rows, profiles).select("doc_id", "held_out", F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))


def acceptance(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang", q: float = 0.02, share: float = 0.65) -> dict[str, float]:
    """The least score that counts as each language: `share` of the score that all but `q` of the labelled rows (of any
    label) that are judged to be of the language reach. Exact on scores rounded down to 1/1000; a language
    without such rows takes the least of the others' scores."""
    judged = identify(docs.filter(col(lang_col).isNotNull()).select(col(text_col).alias("text"), col(lang_col).alias("lang")), profiles)
    found = judged.filter(F.col("__lang_pred") != UNKNOWN).groupBy(F.col("__lang_pred").alias("lang"), F.floor(F.col("__lang_score") * 1000).alias("bin")).count()
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in found.collect():  # 1001 rows a language at most
        counts.setdefault(r["lang"], []).append((r["bin"], r["count"]))
    out = {}
    for lang, bins in counts.items():
        bins.sort()
        upto = np.cumsum([n for _, n in bins])
        out[lang] = share * bins[int(np.searchsorted(upto, q * upto[-1], "right"))][0] / 1000
    return {lang: out.get(lang, min(out.values(), default=0.1)) for lang in profiles.names}


def known_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", q: float = 0.02, share: float = 0.65) -> DataFrame:
    """The rows of docs, all columns, whose language is recognised: those with a letter whose best score is that of
    `acceptance` or more. Where no row has a language to learn from, scores say nothing and only letters count."""
    profiles = train(docs, F.lit(True), text_col, lang_col)
    if not profiles.names:
        return docs.filter(F.coalesce(col(text_col).rlike(r"\p{L}"), F.lit(False)))
    least = acceptance(docs, profiles, text_col, lang_col, q, share)
    limits = docs.sparkSession.createDataFrame(list(least.items()), "__lang_pred string, __least double")
    found = identify(docs, profiles, text_col).filter(F.col("__lang_pred") != UNKNOWN).join(F.broadcast(limits), "__lang_pred")  # profiles' languages: max_languages rows at most
    return found.filter(F.col("__lang_score") >= F.col("__least")).select(*map(col, docs.columns))
