import base64
import hashlib
import itertools
import os
import random
import re
import textwrap
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from flatlake.llm import chat_format, decontamination, language_id, license_scan, packing, quality, warc_index
from flatlake.llm.queries import tokenizer_path

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
DOCS = "doc_id long, text string, lang string, extra string"
EN, DE = "the quick brown fox jumps over the lazy dog and then the other dog ", "der schnelle braune fuchs springt über den faulen hund und dann der andere "


# Language identification


def corpus(n=60):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.sample((EN if k % 2 else DE).split(), 8)), "en" if k % 2 else "de", "x") for k in range(n)]
    return rows + [(1001, None, "en", ""), (1002, "12 !!", "de", ""), (1003, "", None, ""), (None, EN, "de", ""), (1004, EN * 3000, None, "")]


def test_languages(spark):
    got = {r["doc_id"]: r for r in language_id.predict_languages(spark.createDataFrame(corpus(), DOCS)).collect()}
    assert len(got) == 65
    assert all(r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and i is not None and i < 60]
    assert len(held) > 5 and all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in held)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert got[None]["lang_pred"] == "en" and got[1004]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_brute_force(spark):
    df = spark.createDataFrame(corpus(20), DOCS)
    size = 30
    profiles = language_id.train(df, F.lit(True), size=size)
    counts = {}
    for _, t, lang, _ in corpus(20):
        if t and lang:
            for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
                for g in [*w, *(f" {w} "[i : i + 2] for i in range(len(w) + 1)), *(f" {w} "[i : i + 3] for i in range(len(w)))]:
                    counts.setdefault(lang, {}).setdefault(g, 0)
                    counts[lang][g] += 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    for k, lang in enumerate(profiles.names):
        # Blanks shared by neighbouring words are one character, so that pairs around them count once for each word.
        want = sorted(counts[lang].items(), key=lambda x: (-x[1], code(x[0])))[:size]
        got = profiles.known[np.argsort(profiles.rank[k])][: len(want)].tolist()
        assert got == [code(g) for g, _ in want]


def test_language_filter(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    kept = language_id.known_language(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(60)) | {None, 1004}
    unknown = language_id.known_language(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["doc_id"] for r in unknown.collect()} == set(range(60)) | {None, 1004}
    assert language_id.predict_languages(df.limit(0)).collect() == []


def test_language_filter_rejects_unlike_texts(spark):
    """Gibberish and an unlearned language in the same letters go, clean texts stay."""
    rng = random.Random(9)
    english = (EN + "when we came home that night there was nothing left to eat but bread and some cheese which my mother had bought in town ").split()
    german = (DE + "als wir an jenem abend nach hause kamen war nichts mehr zu essen da ausser brot und etwas das meine mutter gekauft hatte ").split()
    rows = [(k, " ".join(rng.choices(german if k % 2 else english, k=80)), "de" if k % 2 else "en", "") for k in range(60)]
    rows += [(100 + k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(80)), None, "") for k in range(10)]
    rows += [(200, "kun tulimme sinä iltana kotiin ei syötävää ollut jäljellä muuta kuin leipää ja juustoa jonka äitini oli ostanut kaupungista " * 4, None, "")]
    assert {r["doc_id"] for r in language_id.known_language(spark.createDataFrame(rows, DOCS)).collect()} == set(range(60))


# Packing


def reference_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 0]


def test_tokenizer_is_the_files():
    rng = random.Random(2)
    own = packing.WordTokenizer(tokenizer_path(), most=500)
    pool = [chr(c) for c in [*range(9, 14), *range(28, 0x250), 0x301, 0x3A3, 0x2019, 0x4E2D]] + ["'s", "'ll", "<|endoftext|>", " ", "a", "E"] * 5
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["", "it's WE'LL  x", "İ ß ſ"]
    for k in range(0, len(texts), 100):
        got = own(texts[k : k + 100])
        assert [g.tolist() for g in got] == [reference_ids(t)[:-1] for t in texts[k : k + 100]]


def test_other_tokenizer_files_are_encoded_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "t.json"))
    own = packing.tokenizer(str(tmp_path / "t.json"))
    assert not own.by_words and packing.tokenizer(tokenizer_path()).by_words
    assert [x.tolist() for x in own(["a b A", "b-a", ""])] == [[0, 1, 2], [1, 2, 0], []]


def test_pack_with_ids(spark):
    texts = [(1, "one two three"), (2, ""), (3, None), (4, "word " * 5000)]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer_path(), with_ids=True).collect()
    for i, t in texts:
        ids = [x for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"]) for x in r["ids"]]
        assert ids == reference_ids(t) and all(len(r["ids"]) == r["length"] for r in got)


def test_pack(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma,", "12"]) for _ in range(rng.choice([0, 3, 40, 200, 900]))), None, "") for k in range(120)]
    rows += [(500, None, None, ""), (501, "word " * 5000, None, ""), (None, "x", None, ""), (7, rows[7][1], None, "")]
    size = 256
    got = packing.pack(spark.createDataFrame(rows, DOCS), tokenizer_path(), size=size).collect()
    want = []
    for i, t, *_ in rows:
        ids = np.array(reference_ids(t), "<u4")
        want += [(i, k, s, len(p), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), size)) for p in [ids[s : s + size]]]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(sequences) <= -(-sum(r["length"] for r in got) // size) + 4
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([64, 100, 2048]))
    lengths = rng.integers(1, size + 1, 3000) if seed % 2 else np.minimum(size, (rng.pareto(1.1, 3000) * size / 8).astype(int) + 1)
    made = packing.plan(np.bincount(lengths, minlength=size + 1), size)
    fill, ranks = {}, {}
    for length, rank, count, sequence, offset in made.uses:
        for k in range(count):
            fill.setdefault(sequence + k, []).append((offset, length))
            ranks.setdefault(length, []).append(rank + k)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert {n: len(r) for n, r in ranks.items()} == {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    free, bins = [], 0  # best-fit decreasing, one by one, as a yardstick
    for n in sorted(lengths.tolist(), reverse=True):
        room = min((f for f in free if f >= n), default=None)
        if room is None:
            bins += 1
            free.append(size - n)
        else:
            free.remove(room)
            free.append(room - n)
    assert len(fill) <= bins * 1.02 + 2


def test_least_squares():
    rng = np.random.default_rng(1)
    a, x = rng.random((20, 8)), np.maximum(0, rng.normal(size=8))
    assert np.allclose(packing.least_squares(a, a @ x), x, atol=1e-6)
    b = rng.normal(size=20)
    got = packing.least_squares(a, b)
    gradient = a.T @ (b - a @ got)
    assert (got >= 0).all() and (gradient <= 1e-6).all() and np.allclose(gradient[got > 0], 0, atol=1e-6)


# Decontamination


def test_masks_hit_every_window():
    for n, mismatches, masks in ((13, 2, decontamination.LONG_MASKS), (8, 1, (decontamination.MIDDLE_MASK,)), (12, 1, (decontamination.MIDDLE_MASK,))):
        for wrong in itertools.combinations(range(n), mismatches):
            assert any(all(m[p - o] == "0" for p in wrong if 0 <= p - o < len(m)) for m in masks for o in range(n - len(m) + 1)), wrong


def brute_overlap(doc, item):
    a, b = decontamination.words(doc), decontamination.words(item)
    if not b:
        return 0
    window, agree, _ = decontamination.terms(len(b))
    best = 0
    for shift in range(-len(b), len(a) + 1):
        held = set()
        for j in range(len(b) - window + 1):
            if sum(0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(j, j + window)) >= agree:
                held |= set(range(j, j + window))
        best = max(best, len(held))
    return best


def test_overlaps(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", *(f"w{k}" for k in range(60))]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 7, 8, 12, 13, 20, 40])))) for k in range(30)] + [(98, None), (99, ""), (3, "The of")]
    docs = [(900, None), (901, ""), (None, items[5][1])]
    for k in range(120):
        words = rng.choice(items[:30])[1].split()
        own = [w if rng.random() > 0.12 else rng.choice(vocabulary) for w in words[rng.randint(0, 3) :]]
        docs.append((k, " ".join([*(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))), *own, *(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))]).title()))
    want = sorted(str((d, i, len(decontamination.words(t)), n)) for d, text in docs for i, t in items if (n := brute_overlap(text, t)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(str(tuple(r)) for r in decontamination.find_overlaps(d, b).collect()) == want
    assert sorted(str(tuple(r)) for r in decontamination.find_overlaps(d, b, block_bytes=500).collect()) == want
    hit = {text for _, text in docs if any(brute_overlap(text, t) for _, t in items)}
    kept = decontamination.without_overlaps(d.withColumn("item_id", F.lit(1)), b, block_bytes=2000)
    assert sorted(str(r["text"]) for r in kept.collect()) == sorted(str(t) for _, t in docs if t not in hit) and kept.columns == ["doc_id", "text", "item_id"]
    assert decontamination.find_overlaps(d, b.limit(0)).collect() == [] and decontamination.without_overlaps(d, b.limit(0)).count() == len(docs)


# Quality


def test_classify(spark):
    rng = random.Random(5)
    clean = [(k, " ".join(rng.sample(EN.split(), 9)), "en", "") for k in range(80)]
    junk = [(200 + k, "".join(rng.choice("#$%&*QZXJ09") for _ in range(60)), "en", "") for k in range(20)]
    rows = [*clean, *junk, (300, None, "en", ""), (301, "", "de", ""), (302, EN, None, ""), (None, EN, "en", "")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(200 + k, 0) for k in range(10)] + [(None, 1), (1, None), (2, 1)], "doc_id long, quality int")
    for bound in (1_000_000, 0):
        got = {r["doc_id"]: r for r in quality.classify(docs, labels, broadcast_ids=bound).collect()}
        assert len(got) == len(rows) and sum(got[k]["keep"] for k in range(80)) >= 60 and not any(got[200 + k]["keep"] for k in range(20))
        assert got[300]["perplexity"] is None and not got[300]["keep"] and not got[301]["keep"] and got[302]["threshold"] == got[0]["threshold"] and got[0]["trusted"]
    unknown = quality.classify(docs, labels.limit(0)).collect()
    assert all(r["threshold"] is None and r["keep"] == bool(r["perplexity"]) for r in unknown)
    assert quality.classify(docs.limit(0), labels).collect() == []


def units(text):
    flat = text.encode("utf-16-le")
    return [0, 0, 0, *(flat[k] + 256 * flat[k + 1] for k in range(0, len(flat), 2))]


def brute_model(texts):
    """Interpolated modified Kneser-Ney in plain Python: a function from (context, symbol) to the probability."""
    top = {}
    for t in texts:
        u = units(t) if t and not t.isspace() else []
        for k in range(3, len(u)):
            top[tuple(u[k - 3 : k + 1])] = top.get(tuple(u[k - 3 : k + 1]), 0) + 1
    levels = [top]
    for _ in range(3):
        lower = {}
        for g in levels[-1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.append(lower)
    cut = [quality.discounts_of(*(sum(n == k for n in c.values()) for k in (1, 2, 3, 4))) for c in levels]
    sums = []
    for c, d in zip(levels, cut, strict=True):
        own = {}
        for g, n in c.items():
            t, left = own.get(g[:-1], (0, 0))
            own[g[:-1]] = t + n, left + d[min(n, 3) - 1]
        sums.append(own)

    def p(g, known, at=0):
        if at == 4:
            return 1 / (known + 1)
        n, (t, left) = levels[at].get(g, 0), sums[at].get(g[:-1], (0, 0))
        share = (n - cut[at][min(n, 3) - 1]) / t if n else 0
        return share + (left / t if t else 1) * p(g[1:], known, at + 1)

    return p, len(levels[3])


@pytest.mark.parametrize("held", [1 << 20, 50, 0])
def test_perplexity_brute_force(spark, held):
    """Perplexities, thresholds and what is kept, against plain Python; n-grams held by the tasks, some of them, or none."""
    rng = random.Random(11)
    plain = ("съешь ещё этих мягких французских булок да выпей же чаю 我喜欢吃苹果 😀 " + EN + DE).split()
    rows = [(k, " ".join(rng.choices(plain, k=rng.randint(1, 12))), rng.choice(["en", "ru"]), "") for k in range(60)]
    rows += [(100, None, "en", ""), (101, "", "en", ""), (102, " \n", "ru", ""), (103, "zzz \x00 unseen ß", "xx", ""), (None, EN, None, ""), (3, EN, "en", "")]
    trusted = set(range(0, 40)) | {101}
    labels = spark.createDataFrame([(k, 1) for k in sorted(trusted)] + [(50, 0), (None, 1), (2, 1), (7, None)], "doc_id long, quality int")
    got = quality.classify(spark.createDataFrame(rows, DOCS), labels, q=0.9, held=held).collect()
    half = lambda i: zlib.crc32(str(i).encode()) % 2 + 1
    own = [(i, t) for i, t, _, _ in rows if i in trusted]
    models = [brute_model([t for _, t in own]), *(brute_model([t for i, t in own if half(i) != k]) for k in (1, 2))]
    known = models[0][1]
    want, bins = [], {}
    for i, t, lang, _ in rows:
        u = units(t) if t and not t.isspace() else []
        p = models[half(i) if i in trusted else 0][0]
        loss = -sum(np.log(p(tuple(u[k - 3 : k + 1]), known)) for k in range(3, len(u))) / (len(u) - 3) if u else None
        want.append((i, t, lang, loss))
        if i in trusted and u:
            for key in {lang, None}:
                bins.setdefault(key, []).append(round(loss * 1000))
    limit = {k: sorted(v)[int(np.ceil(0.9 * len(v))) - 1] for k, v in bins.items()}
    expect = sorted((str(i), i in trusted, loss and round(loss, 4), loss is not None and round(loss * 1000) <= limit.get(lang, limit[None])) for i, _, lang, loss in want)
    assert sorted((str(r["doc_id"]), r["trusted"], r["perplexity"] and round(float(np.log(r["perplexity"])), 4), r["keep"]) for r in got) == expect
    assert {round(r["threshold"], 6) for r in got} == {round(float(np.exp(v / 1000)), 6) for v in limit.values()}


def test_probabilities_sum_to_one(spark):
    texts = [(EN * 2, 1), (DE, 2), ("Съешь ещё этих мягких булок", 1), (None, 1)]
    p, known = brute_model([t for t, _ in texts])
    symbols = {u for t, _ in texts for u in units(t or "")[3:]}
    assert known == len(symbols)
    for context in [(0, 0, 0), tuple(map(ord, "the")), tuple(map(ord, "xqz"))]:
        assert abs(sum(p((*context, s), known) for s in symbols) + p((*context, 1), known) - 1) < 1e-9
    table = quality.probabilities(quality.count_grams(spark.createDataFrame(texts, "text string, half int")))
    for r in table.collect():
        g = tuple(r["gram"] >> 16 * k & 0xFFFF for k in (3, 2, 1, 0))
        assert abs(r["p0"] - p(g, known)) < 1e-9


def test_grams_of_long_texts():
    text = "".join(random.Random(2).choices("abcdé😀", k=5000))
    whole, _ = next(quality.grams([text]))
    parts = list(quality.grams([None, "ab", text, ""], most=700))
    assert np.array_equal(np.concatenate([g for g, _ in parts])[2:], whole) and {int(x) for _, w in parts for x in w} == {1, 2}


def test_model_grows_with_the_input(spark):
    more = spark.createDataFrame([("".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyzäöüß", k=200)), 1) for k in range(2000)], "text string, half int")
    assert quality.count_grams(more).count() > quality.count_grams(more.limit(200)).count() * 7


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_unseen_trusted_texts_are_kept_at_the_quantile(spark):
    """With half of the labels hidden, trusted texts that the model hasn't seen are kept at about the quantile."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    good = labels.filter("quality = 1").select("doc_id").distinct()
    shown = labels.filter("quality = 1 and crc32(cast(concat('x', doc_id) as binary)) % 2 = 0")
    found = quality.classify(docs, shown).join(good, "doc_id").filter("not trusted and perplexity is not null")
    share = found.agg(F.avg(F.col("keep").cast("int"))).first()[0]
    assert share > 0.95


def test_classify_beyond_ascii(spark):
    rng = random.Random(7)
    plain = "съешь ещё этих мягких французских булок да выпей же чаю".split()
    junk = lambda n: "".join(rng.choice("абвгдежзийклмнопрстуфхцчшщъыьэюя") for _ in range(n))
    rows = [(k, " ".join(rng.sample(plain, 8)), "ru", "") for k in range(60)] + [(100 + k, " ".join(junk(len(w)) for w in rng.sample(plain, 8)), "ru", "") for k in range(20)]
    rows += [(7, "", "ru", ""), (8, " \n", "ru", "")]
    got = quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    assert sum(r["keep"] for r in got if 40 <= r["doc_id"] < 60) >= 15 and not any(r["keep"] for r in got if r["doc_id"] >= 100)
    assert sum(r["perplexity"] is None and not r["keep"] for r in got) == 2


# Licenses


def licenses(spark, texts, known=None, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["license_id"] for r in sorted(license_scan.scan(rows, known, **more).collect())]


def whole_texts():
    return {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(license_scan.__file__).parent / "licenses").glob("*.txt"))}


def test_scan(spark):
    mit = "The MIT License (MIT)\n\n" + whole_texts()["MIT"]
    changed = mit.replace("<year> <copyright holders>", "1999 Some One\nAll rights reserved.").replace("Software", "SOFTWARE").replace(",", " , ").replace("License", "Licence")
    rows = [(1, mit), (2, changed), (3, "hello\nReleased under the MIT Licence.\nLicensed under CC BY-NC 4.0"), (4, None), (5, ""), (None, "Copyright 2020 X"), (6, "long " * 20000), (6, "long " * 20000), (7, mit + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x"))
    for known, bound in ((None, 10_000), (license_scan.known_texts(spark), 0)):
        got = license_scan.scan(df, known, broadcast_rows=bound).collect()
        assert len(got) == len(rows)
        by = {r["doc_id"]: (r["license_id"], r["notices"], r["n_notices"]) for r in got}
        assert by == {1: ("MIT", "", 0), 2: ("MIT", "", 0), 3: (None, "CC-BY-NC-4.0 MIT", 2), 4: (None, "", 0), 5: (None, "", 0), None: (None, "", 0), 6: (None, "", 0), 7: (None, "", 0)}
    assert license_scan.scan(df.limit(0)).collect() == []


def test_every_known_text_however_wrapped(spark):
    """All whole texts, wrapped anew, as comments, without the copyright statement's line, and with a clause of their own."""
    wrapped, names = [], []
    for name, text in whole_texts().items():
        paragraphs = re.split(r"\n\s*\n", text)
        for width in (40, 60, 72, 80, 1_000_000):
            lines = [w for p in paragraphs for w in [*textwrap.wrap(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False), ""]]
            wrapped += ["\n".join(lines), "\n".join("# " + x for x in lines), "\n".join(lines) + "\nمع شرط آخر"]
            names += [name, name, None]
    assert licenses(spark, wrapped) == names


def test_statements_of_copyright(spark):
    body = whole_texts()["0BSD"]
    heads = ["Copyright 2020 A", "(c) 2021 B", "© C", "Copyright (C) <year>  <name of author>", "Copyright Jane Doe", "Copyright by Jane Doe", "All rights reserved.", "# Copyright, 1999 D"]
    others = ["Copyright holders may object", "copyright law applies", "Copyright notices stay", "my copyright 2020"]
    assert licenses(spark, [f"{h}\n{body}" for h in heads]) == ["0BSD"] * len(heads)
    assert licenses(spark, [f"{h}\n{body}" for h in others]) == [None] * len(others)


def test_terms_beside_a_statement_stay(spark):
    """What a line says besides its statement of copyright is part of the text."""
    mit = whole_texts()["MIT"]
    body = mit[mit.index("Permission") :]
    own = ["Copyright (c) 2020 Foo. Commercial use is prohibited.", "Copyright Foo forbids any use", "Copyright 2021 Foo, and you must pay Foo 5 USD", "Copyright (c) 2020 Foo Commercial Use Prohibited", "(c) 2020 Foo; not for sale", "Copyright (C) 2020 FOO. NO COMMERCIAL USE."]
    assert licenses(spark, [f"{x}\n\n{body}" for x in own] + [f"{body}\n{x}" for x in own]) == [None] * 2 * len(own)
    names = [
        "Copyright (c) 2020 The Foo Bar\nHolding Company of Baz", "Portions Copyright (c) 1999-2004 Jane Q. Public <jane@foo.example>", "Copyright 2020, 2021 Foo Inc., Bar Ltd. and Baz", "© 2020 Ürün Ağ", "Copyright (c) 2020 Foo. All rights reserved.", "# Copyright © 2001 by Foo",
        "Copyright 2020 日本", "Copyright (c) 2015-present Foo & Bar", "Copyright (c) 2010 Foo\nCopyright (c) 2011 Bar\n Copyright (c) 2012 Baz",
    ]
    assert licenses(spark, [f"{x}\n\n{body}" for x in names]) == ["MIT"] * len(names)
    assert licenses(spark, [" ".join(f"Copyright (c) 2020 Foo Bar {body}".split())]) == ["MIT"]
    bsd = whole_texts()["BSD-3-Clause"]
    named = [bsd.replace("the copyright holder nor", f"{x} nor") for x in ("Foo Corp", "the Foo Foundation", "the copyright holders", "FOO", "<organization>")]
    assert named[0] != bsd and licenses(spark, [*named, bsd.replace("the copyright holder nor", "those who pay nor")]) == ["BSD-3-Clause"] * 5 + [None]


def test_known_texts_of_the_caller(spark):
    clause = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    known = spark.createDataFrame([("own", clause), ("own-zh", "保留所有权利"), ("b", "!!"), ("a", clause.upper())], "license_id string, text string")
    rows = spark.createDataFrame([(1, f"x\n{clause}\ny"), (2, "保留所有权利"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in license_scan.scan(rows, known).collect()}
    assert got == {1: (None, "a"), 2: ("own-zh", "own-zh"), 3: (None, "")}


def test_scan_all_scripts_and_one_line_licenses(spark):
    zero = " ".join(whole_texts()["0BSD"].split())
    rows = [(1, "这是一个文件。\nReleased under the MIT License."), (2, "这是一个文件 Released under the MIT License."), (3, "我喜欢"), (4, "こんにちは"), (5, ""), (6, "Copyright (C) 2020 by Some One. " + zero), (7, "Copyright 2020 A\nCopyright 2021 B\n" + zero)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["license_id"] for k in range(1, 8)] == [None] * 5 + ["0BSD"] * 2 and got[1]["notices"] == "MIT" and got[2]["notices"] == ""
    assert len({got[k]["canonical_sha256"] for k in (1, 3, 4, 5)}) == 4


# Chats


def chat_brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def test_chat_round_trip(spark):
    rng = random.Random(6)
    parts = ["<|im_start|>", "<|im_end|>", "\n", "<|", "|>", "<\\|", "<\\\\|", "\\", "\\n", "a", "é", "😀", "assistant", ""]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, None]), rng.choice(["user", "assistant", None, "us\\ner\n<|x"]), rng.choice([None, "".join(rng.choice(parts) for _ in range(8))])) for _ in range(120)]
    rows += [(9, k, "assistant", "x" * 20000) for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.round_trip(chat_format.from_table(df)).collect()}
    assert got == chat_brute(rows)
    assert chat_format.round_trip(chat_format.from_table(df.limit(0))).collect() == []
    plan = chat_format.round_trip(chat_format.from_table(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', "messages", [("user", "hi"), ("assistant", "yo")]), (2, '{"response":"r","prompt":"p"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
        (3, '{"instruction":"i","input":"","output":"o"}', "instruction_input", [("user", "i"), ("assistant", "o")]), (4, '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":null}]}', "conversations", [("user", "h"), ("assistant", "")]),
        (5, '{"x":1}', None, None), (6, None, None, None), (7, "not json", None, None),
        # Further fields, of the record and of messages; empty and partly filled lists; wrapped records; content in parts.
        (8, '{"messages":[{"role":"user","content":"hi","name":"n"}],"source":"s","id":4}', "messages", [("user", "hi")]), (9, '{"messages":[]}', "messages", []),
        (10, '{"messages":[{"content":"hi"},{"role":"assistant"},7]}', "messages", [("", "hi"), ("assistant", "")]), (11, '{"data":{"prompt":"p","response":"r"},"meta":{"a":{"b":1}}}', "prompt_response", [("user", "p"), ("assistant", "r")]),
        (12, '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image","url":"u"},"b"]},{"role":"gpt","content":"[1]"}]}', "messages", [("user", "a\nb"), ("assistant", "[1]")]),
        (13, '[{"role":"user","content":"x"}]', "messages", [("user", "x")]), (14, '{"a":{"b":{"question":"q","answer":"z","n":1}}}', "question_answer", [("user", "q"), ("assistant", "z")]), (15, '{"prompt":"p","response":"r","tags":["x"],"system":"s"}', "system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        (16, "", None, None), (17, '{"a b\'c":{"prompt":1}}', None, None), (18, '{"prompt":null,"response":5}', "prompt_response", [("user", ""), ("assistant", "5")]),
    ]
    got = chat_format.from_json(spark.createDataFrame([r[:2] for r in records], "conv_id long, record string")).collect()
    assert {r["conv_id"]: (r["layout"], None if r["turns"] is None else [tuple(t) for t in r["turns"]]) for r in got} == {i: (layout, turns) for i, _, layout, turns in records}
    table = spark.createDataFrame([(1, "p", None, "x")], "id long, prompt string, response string, source string")
    assert [tuple(t) for t in chat_format.from_table(table).first()["turns"]] == [("user", "p"), ("assistant", "")]
    nested = spark.createDataFrame([(1, [("user", "a")]), (2, None)], "id long, messages array<struct<role: string, content: string>>").withColumn("extra", F.lit(1))
    assert [len(r["turns"]) for r in chat_format.from_table(nested).orderBy("conv_id").collect()] == [1, 0]
    with pytest.raises(ValueError):
        chat_format.from_table(spark.createDataFrame([(1, 2)], "a int, b int"))


# Archives


def test_archives(spark, tmp_path):
    rng = random.Random(7)
    pages = [(k, rng.choice(["http://a.example/x", "https://www.b.example:8080/Y?q=1#f", None, "http://c.example/\r\nz", "::", "http://[bad", ""]), rng.choice([None, "", "same", "é<html>\r\n\r\nWARC/1.0\r\n" * rng.randint(1, 3)])) for k in range(150)]
    pages += [(7, "http://a.example/x", "same"), (None, "u", "same"), (None, "u", "alone"), (999, "http://big.example/", "y" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc_index.capture_history(df, str(tmp_path / "w"), per_file=20).collect()
    assert len(got) == len(pages) and len({r["archive"] for r in got}) > 5
    keys = [warc_index.order(tuple(r)) for r in got]
    assert keys == sorted(keys)
    want = []
    for i, u, h in pages:
        top = max((j for j, _, g in pages if (g or "") == (h or "") and j is not None), default=None)
        payload = (h or "").encode()
        kind = "response" if top is None or i == top else "revisit"
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, top if kind == "revisit" else None, u))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"])) for r in got)
    apart = warc_index.read_archives(spark, str(tmp_path / "x")) if warc_index.write_archives(df, str(tmp_path / "x"), 20, 1_000_000) is None else None
    assert apart.count() == len(pages) and (tmp_path / "x/large").is_dir()
    large = warc_index.capture_history(df, str(tmp_path / "v"), least_bytes=5).filter("payload_bytes < 5 AND record_type <> 'response'")
    assert large.count() == 0
    assert warc_index.capture_history(df.limit(0), str(tmp_path / "e")).collect() == []


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 50), r, n) for n in range(rng.choice([0, 1, 30]))) for r in range(k)]
    assert list(warc_index.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc_index.url_key("https://www.B.example:8080/Y/?q=1#f") == "example,b:8080)/y?q=1" and warc_index.url_key(None) == ""
