import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flatlake.llm import components as module
from flatlake.llm import exact_dedup, simhash_dedup, suffix_dedup
from flatlake.llm.components import components

DOCS = "doc_id long, text string, extra string"
EDGES = [(1, None, "a"), (2, "", "b"), (3, "One two", None), (4, "ONE TWO", "d"), (4, "ONE TWO", "d"), (None, "one two", "e"), (None, None, None), (5, "É", "f"), (6, "é", "g"), (7, "x" * 50_000, "h"), (8, "X" * 50_000, "i")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def saved(spark, tmp_path, rows, schema=DOCS, parts=3):
    path = str(tmp_path / f"d{random.random()}")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


# Exact


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for t, members in groups.items():
        keep, used = max((m for m in members if m is not None), default=None), False
        for m in sorted(members, key=str):
            kept = m == keep and not used
            used |= kept
            out.append((m, keep, len(members), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("digest", [exact_dedup.digest_of, lambda c: F.substring(F.unhex(F.md5(c)), 1, 0), lambda c: F.substring(F.unhex(F.md5(c)), 1, 1)])
def test_exact(spark, digest):
    rng = random.Random(1)
    rows = EDGES + [(100 + k, rng.choice(["aa", "Aa", "b", "", None, "c" * rng.randint(1, 3)]), "z") for k in range(80)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), digest=digest).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_exact(rows)


def test_exact_empty_and_copies(spark, monkeypatch):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).collect() == []
    monkeypatch.setattr(exact_dedup, "BLOCK", 3)
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, "t", "x")] * 10, DOCS)).collect()
    assert len(got) == 10 and sum(r["kept"] for r in got) == 1 and {r["group_size"] for r in got} == {10}


def test_drop_copies(spark):
    kept = exact_dedup.drop_copies(spark.createDataFrame(EDGES, DOCS))
    assert kept.columns == ["doc_id", "text", "extra"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "4", "5", "6", "8"]


# Near


def brute_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(prints, most):
    unique = sorted(set(prints))
    root = list(range(len(unique)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(unique)):
        for j in range(i):
            if (unique[i] ^ unique[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {p: unique[find(k)] for k, p in enumerate(unique)}


def test_near_duplicates(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = list(EDGES)
    for k in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 400))]
        for j in range(rng.randint(1, 4)):
            rows.append((1000 + 10 * k + j, " ".join(words), "z"))
            words[rng.randrange(len(words))] = "changed"
    prints = [brute_print(t) for _, t, _ in rows]
    root = roots(prints, 4)
    least = {}
    for (i, *_), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = sorted(str((i, f"{p:016x}", least.get(root[p]))) for (i, *_), p in zip(rows, prints, strict=True))
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    kept = simhash_dedup.drop_near_copies(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "extra"] and sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


@pytest.mark.parametrize("most, heavy", [(4, 50_000), (4, 8), (2, 5), (0, 100)])
def test_links_are_whole(spark, most, heavy):
    """Random codes, near codes, and a dense ball; small `heavy` values force longer patterns."""
    rng = random.Random(3)
    codes = {rng.getrandbits(64) for _ in range(40)}
    for c in list(codes)[:10]:
        for _ in range(15):
            codes.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))))
    center, bits = rng.getrandbits(64), rng.sample(range(64), 12)
    codes |= {center ^ sum(1 << b for b in bits if rng.random() < 0.5) for _ in range(150)}
    df = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c, 0) for c in codes], "fp long, fp2 long")
    got = {r["a"] % 2**64: r["b"] % 2**64 for r in components(simhash_dedup.links(df, most, heavy)).collect()}
    groups, want = {}, {}
    for c in codes:
        groups.setdefault(got.get(c, c), set()).add(c)
    for c, r in roots(codes, most).items():
        want.setdefault(r, set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_masks_hold_every_pair():
    rng = random.Random(4)
    masks = simhash_dedup.split_bits(list(range(64)), 4)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & diff for m in masks)
    deepest = {d for m in masks for e in simhash_dedup.deeper(m, 4) for d in simhash_dedup.deeper(e, 4)}
    assert min(m.bit_count() for m in deepest) >= 42


def test_gray_rank():
    codes = np.array([k ^ (k >> 1) for k in range(1000)], np.uint64)
    assert simhash_dedup.gray_rank(codes).tolist() == list(range(1000))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in root} == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.fixture
def many_partitions(spark):
    """Shuffles of 96 partitions, which stay as they are however small."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "96")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_edges_take_few_partitions(spark, monkeypatch, many_partitions):
    """Each round writes as many files as its edges need, not as many as a shuffle has partitions."""
    written, pinned = [], module.pinned

    def counted(df):
        out = pinned(df)
        written.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(module, "pinned", counted)
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)]
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 301)} | {k: 1000 for k in range(1001, 1200)}
    assert len(written) > 3 and max(written[1:]) <= 8


# Repeated strings


def brute_repeats(rows, size=200):
    seen = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            seen[b[p : p + size]] = seen.get(b[p : p + size], 0) + 1
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p] += 1
                gone[p + size] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("block, together, heavy", [(1_000_000, 500_000, 2000), (700, 2000, 2000), (5000, 3000, 2)])
def test_repeats(spark, tmp_path, monkeypatch, block, together, heavy):
    for name, value in (("BLOCK", block), ("TOGETHER", together), ("HEAVY", heavy)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    base = [" ".join(word() for _ in range(rng.randint(30, 300))) for _ in range(12)]
    rows = [(-1, None, ""), (-2, "", ""), (-3, "a" * 199, ""), (-4, "a" * 200, ""), (-5, "b" * 201, ""), (-6, "ab" * 300, ""), (-7, "é" * 150, ""), (-7, "é" * 150, ""), (None, "é" * 150, "")]
    rows += [(k, t, "") for k, t in enumerate(base)]
    for k in range(60):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        rows.append((100 + k, f"q{k} " + a[i : i + rng.randint(150, 320)] + " z " + b[j : j + rng.randint(190, 215)], ""))
    got = suffix_dedup.remove_repeats(saved(spark, tmp_path, rows)).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == brute_repeats(rows)
    assert all(sum(s["length"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_repeats_empty(spark, tmp_path):
    assert suffix_dedup.remove_repeats(saved(spark, tmp_path, [])).collect() == []


def test_linked_pairs_hold_few_at_once():
    """Texts that share a common passage and nothing else: no node prunes, and all pairs of leaves are wanted in turn."""
    import tracemalloc

    import numpy as np

    from flatlake.llm.simhash_dedup import gray_rank, linked_pairs

    fps = np.random.default_rng(7).integers(0, 2**64, 4000, np.uint64)
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    tracemalloc.start()
    found = sum(len(i) for i, _ in linked_pairs(fps, 18))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == sum(int((np.bitwise_count(fps[k] ^ fps[k + 1 :]) <= 18).sum()) for k in range(len(fps)))
    assert peak < 50_000_000
