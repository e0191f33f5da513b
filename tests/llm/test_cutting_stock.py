import itertools
import random
import zlib

import numpy as np
import pytest

from flatlake.llm import cutting_stock
from flatlake.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, sequence_id string"


def token_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def check(pieces, documents, size):
    """Every id in one piece, sequences without gaps, no padding; how many documents of up to size tokens are cut."""
    wanted = sorted((d is None, d or 0, ids) for d, ids in documents)
    sequences, by_doc = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"] is None, p["doc_id"] or 0, p["doc_tokens"]), []).append(p)
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == sum(len(ids) for _, _, ids in wanted)
    for spots in sequences.values():
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(spots))) and min(spots)[0] == 0
        total = sum(n for _, n in spots)
        assert total == size or total < size and total & (total - 1) == 0
    for none, doc, ids in wanted:
        mine = by_doc[none, doc, len(ids)]
        spans = sorted({(p["start"], p["length"]) for p in mine})
        assert sum(n for _, n in spans) % len(ids) == 0 and spans[0][0] == 0
        for p in mine:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
            if "ids" in p:
                assert p["ids"] == ids[p["start"] : p["start"] + p["length"]]
    return sum(len(own) > 1 for key, own in by_doc.items() if key[2] <= size)


@pytest.mark.parametrize("size,units", [(64, 16), (64, 64), (100, 8), (4096, 128)])
def test_packed(spark, size, units):
    rng = random.Random(size)
    words = ["the", "quick", "brown", "fox", "überall", "naïve", "12", "don't", "…", "日本"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(int(rng.lognormvariate(3, 1)))), "x") for k in range(300)]
    rows += [(k, "hot words here", "x") for k in range(300, 400)] + [(400, None, "x"), (401, "", None), (402, " \n", "x"), (403, "long " * 3000, "x"), (404, "<|endoftext|> x", "x"), (5, rows[5][1], "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    made = [r.asDict() for r in cutting_stock.pack(df, tokenizer_path(), size=size, units=units, with_ids=True, most=0 if units == 8 else 1000).collect()]
    documents = list(zip([r[0] for r in rows], token_ids([r[1] for r in rows]), strict=True))
    assert check(made, documents, size) <= 0.25 * len(rows)
    plain = cutting_stock.pack(df, tokenizer_path(), size=size, units=units)
    assert plain.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert plain.count() == len(made)


def test_packed_edges(spark):
    assert cutting_stock.pack(spark.createDataFrame([], DOCS), tokenizer_path()).collect() == []
    one = cutting_stock.pack(spark.createDataFrame([(1, None, "x")], DOCS), tokenizer_path()).collect()
    assert [tuple(r) for r in one] == [(1, 0, 1, zlib.crc32(b"\2\0\0\0"), 1, one[0]["sequence_id"], 0)]


def test_knapsack():
    rng = np.random.default_rng(2)
    for _ in range(40):
        room = int(rng.integers(1, 12))
        values = np.where(rng.random(room) < 0.3, -np.inf, rng.random(room))
        best = max(sum(values[k - 1] for k in picked) for n in range(room + 1) for picked in itertools.combinations_with_replacement(range(1, room + 1), n) if sum(picked) <= room) if room < 9 else None
        worth, counts = cutting_stock.knapsack(values, room)
        assert (np.arange(1, room + 1) @ counts) <= room and abs(sum(v * c for v, c in zip(values, counts, strict=True) if c) - worth) < 1e-9
        assert best is None or abs(best - worth) < 1e-9


def all_patterns(room, largest=None):
    yield ()
    for k in range(min(room, largest or room), 0, -1):
        for rest in all_patterns(room - k, k):
            yield (k, *rest)


def test_linear_program():
    """Column generation against the dual: no pattern is worth more than a bin at prices that pay for all bins used."""
    rng = np.random.default_rng(3)
    for room in (1, 2, 5, 8, 10):
        for _ in range(6):
            demand = rng.integers(0, 30, room) * (rng.random(room) < 0.7)
            made = cutting_stock.column_generation(demand, room)
            covered = sum((p * x for p, x in made), np.zeros(room))
            assert np.allclose(covered, demand) and all(p @ np.arange(1, room + 1) <= room and x > 0 for p, x in made) and len(made) <= np.count_nonzero(demand)
            bins = sum(x for _, x in made)
            a = np.array([[p.count(k) for k in range(1, room + 1)] for p in all_patterns(room) if p], float)
            assert bins >= demand @ np.arange(1, room + 1) / room - 1e-6
            # Prices by complementary slackness: each used pattern is worth one bin.
            wanted = np.flatnonzero(demand)
            if len(made) == len(wanted) and len(wanted):
                prices = np.zeros(room)
                prices[wanted] = np.linalg.solve(np.array([p[wanted] for p, _ in made], float), np.ones(len(made)))
                mine = a[(a[:, demand == 0] == 0).all(axis=1)]
                assert (mine @ prices <= 1 + 1e-6).all() and abs(prices @ demand - bins) < 1e-6


@pytest.mark.parametrize("rows", [0, 1, 50, 20_000, 3_000_000])
def test_plans(rows):
    rng = np.random.default_rng(rows)
    lengths = np.clip(rng.lognormal(5.5, 1.3, rows), 1, 30_000).astype(int)
    line = int(lengths[lengths > 4096].sum())
    made = cutting_stock.plan(np.bincount(lengths[lengths <= 4096], minlength=4097), line)
    held = sum(sum(run) * count for run, count in made.runs)
    assert held + made.left @ np.arange(4097) + line == lengths.sum() == held + sum(size * count for _, size, _, _, count in made.cells)
    assert made.sequences <= lengths.sum() / 4096 + 13 and len(made.runs) < 12_000
    if rows > 10_000:
        assert made.left.sum() < 0.05 * rows
