import os
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from flatlake.llm import alike, decontamination

from .test_dedup import LOWER

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = text.translate(LOWER).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, tmp_path):
    item = "seven green bottles were standing on the old stone wall behind our little house today"
    words = [f"word{k:03}x" for k in range(400)]
    as_letters = lambda w: re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], w)
    base = " ".join(map(as_letters, words))
    near = base.replace(as_letters("word200x"), "changed")
    rows = [
        (1, base, "en"), (2, base.upper(), "en"), (3, near, "en"), (4, "hello there good people " + item, "en"), (5, None, "en"), (6, "123 ###", None), (7, "", "de"), (8, "a quiet text about rivers and hills", "en"), (8, "a quiet text about rivers and hills", "en"),
        (None, "another text that nobody has numbered", None), (9, "über den wolken ist die freiheit grenzenlos " * 3000, "de"),
    ]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "sf/documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "sf/documents.parquet")), [r[:2] for r in rows]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path / "sf"))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {i for i, _ in kept}
            break
        if name == "language_id":
            kept = [(i, t) for i, t in kept if t and re.search("[a-zA-Z]", t)]
        elif name == "exact_dedup":
            best = {}
            for i, t in kept:
                k = t.translate(LOWER)
                if k not in best or (i or -1) > (best[k][0] or -1):
                    best[k] = (i, t)
            kept = list(best.values())
        elif name == "near_dedup":
            sets = [shingle_set(t) for _, t in kept]
            root = list(range(len(kept)))
            for i in range(len(kept)):
                for j in range(i):
                    if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        root = [root[j] if r == root[i] else r for r in root]
            least = {}
            for (i, t), r in zip(kept, root, strict=True):
                if r not in least or (i is not None and (least[r][0] is None or i < least[r][0])):
                    least[r] = (i, t)
            kept = list(least.values())
            assert len(kept) == 5
        elif name == "decontamination":
            kept = [(i, t) for i, t in kept if not decontamination.Index([(1, item)]).overlaps(t)]
        assert out.columns == docs.columns
        assert sorted(map(str, kept)) == sorted(str((r["doc_id"], r["text"])) for r in out.collect()), name
        docs = out


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_near_dedup_measures_jaccard(spark):
    """Against brute force: near copies just above and just below 0.8, chains of them, and a passage that many share."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    passage = [word() for _ in range(40)]
    texts = [" ".join([*passage, *(word() for _ in range(100))]) for _ in range(30)]
    for k in range(60):
        base = [word() for _ in range(rng.randint(60, 200))]
        edits = rng.randint(1, max(2, len(base) // 25))
        for _ in range(3):
            own = list(base)
            for at in rng.sample(range(len(base)), edits):
                own[at] = word()
            texts.append(" ".join(own))
            base = own if k % 3 == 0 else base
    texts += ["", "one", "One", "one two"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in texts)]
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    root, near = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            near += len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])
            if alike(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    want = {i for i, r in enumerate(root) if i == r}
    assert len(want) < len(texts) - 20 and near > len(texts) - len(want) + 40
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_near_dedup_on_a_whole_table(spark):
    """All pairs of all texts of a table: those alike by 0.8 or more are joined (recall of 0.9 at least), and no others are
    but those that true links connect."""
    texts = spark.read.parquet(f"{TABLES}/documents.parquet").filter("text IS NOT NULL").select(F.xxhash64("text").alias("key"), "text").dropDuplicates(["key"])
    sets = {r["key"]: shingle_set(r["text"]) for r in texts.collect()}
    keys = sorted(sets)
    true, links = {k: k for k in keys}, []
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.append((a, b))
                low, high = sorted((true[a], true[b]))
                true = {k: low if r == high else r for k, r in true.items()}
    found = {r["key"]: r["root"] for r in alike.roots_of(texts, 5, 0.8, 30, 4).collect()}
    assert sum(found.get(a, a) == found.get(b, b) for a, b in links) >= 0.9 * len(links)
    assert all(true[k] == true[r] for k, r in found.items())


def test_large_groups_of_near_copies(spark):
    """One group of near copies, chained, and one of unlike texts that share a passage; more than an index node holds."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    base = [word() for _ in range(150)]
    texts = []
    for _ in range(120):
        own = list(base)
        for at in rng.sample(range(150), rng.randint(0, 6)):
            own[at] = word()
        texts.append(" ".join(own))
    passage = [word() for _ in range(60)]
    texts += [" ".join([*passage, *(word() for _ in range(90))]) for _ in range(120)]
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in alike.drop_alike(docs).collect()}
    assert abs(len(got) - len(set(root))) <= 2 and got <= set(range(len(texts)))


@pytest.mark.parametrize("bits, nearest, block", [(0, 1, 40), (30, 4, 4096)])
def test_no_pair_of_near_copies_is_left(spark, monkeypatch, bits, nearest, block):
    """A passage that many short texts share, and links just above 0.8, whatever the index finds: all are joined."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    passage = [word() for _ in range(100)]
    texts = [" ".join([*passage, *(word() for _ in range(rng.choice([8, 11, 30])))]) for _ in range(90)]
    sets = [shingle_set(t) for t in texts]
    root, links = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links += 1
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert links > 100 and 5 < len(set(root)) < 70
    monkeypatch.setattr(alike.crossing, "__defaults__", (block,))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in alike.drop_alike(docs, bits=bits, nearest=nearest).collect()} == {i for i, r in enumerate(root) if i == r}


def test_pairs_of_a_large_group_stay_in_their_tasks(spark, monkeypatch):
    """Texts alike by a little less than 0.8, and some pairs by more, of one group: the pairs that are shuffled grow with the texts, not
    with the square of their number, and none alike is lost."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    passage = [word() for _ in range(100)]
    texts = [" ".join([*passage, *(word() for _ in range(13))]) for _ in range(140)]
    texts += [f"{t} {word()}" for t in texts[:10]]
    shuffled, compared = [], alike.compared

    def counted(texts, pairs, *rest):
        shuffled.append(pairs.count())
        return compared(texts, pairs, *rest)

    monkeypatch.setattr(alike, "compared", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in alike.drop_alike(docs, bits=0, nearest=1).collect()}
    assert got == set(range(140)) and max(shuffled) <= 16 * len(texts)


def test_rounds_over_few_pairs_take_few_tasks(spark):
    """Shuffles of 96 partitions, which stay as they are however small: near-dedup's tasks don't each write files in every round."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    base = [word() for _ in range(150)]
    texts = [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(20, 60)] + [" ".join(word() for _ in range(80)) for _ in range(60)]
    settings = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    status, group = spark.sparkContext.statusTracker(), "few-pairs"
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, "")
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r["doc_id"] for r in alike.drop_alike(docs).collect()} == {0, *range(40, 100)}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := status.getStageInfo(s)))
    assert tasks < 5000


def test_texts_meet_only_those_they_share_values_with(spark, monkeypatch):
    """Many passages, each shared by twenty texts alike by a little less than 0.8, and blocks of few texts: what is dealt to tasks grows
    with the texts, not with the pairs of blocks."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    texts = []
    for _ in range(12):
        passage = [word() for _ in range(100)]
        texts += [" ".join([*passage, *(word() for _ in range(13))]) for _ in range(20)]
    dealt, kind = [], type(spark.range(1))
    repartition = kind.repartition

    def counted(self, *by):
        if "shared" in self.columns:
            dealt.append(self.count())
        return repartition(self, *by)

    monkeypatch.setattr(kind, "repartition", counted)
    monkeypatch.setattr(alike.crossing, "__defaults__", (40,))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in alike.drop_alike(docs, bits=0, nearest=1).collect()} == set(range(240))
    assert dealt and max(dealt) <= 2 * len(texts)


def test_sketches_of_unlike_lengths_meet():
    """Pairs of large sets are told apart by their own classes, though a small set is among the texts."""
    import numpy as np

    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (40, 3000, 3000, 2500)] + [np.zeros(0, np.uint64)]
    own.append(np.unique(np.concatenate([own[1][: int(0.9 * 3000)], own[2][:200]])))
    held = [alike.sketch(x, 4) for x in own]
    shared = [np.zeros(1, np.int32)] * len(own)
    side = np.zeros(len(own), bool)
    assert list(alike.meeting(np.arange(len(own)), side, held, shared, 0.8, None)) == [(1, 5)]
