import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from flatlake.llm import prefix_trie, queries, structure_repair
from flatlake.llm.common import HELD
from flatlake.llm.structure_repair import Decoder

CHATS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# Structure repair


def all_repairs(rows):
    """The cheapest repair of few rows, letters first, by trying all: (cost, letters, repaired turns)."""
    best = None

    def go(k, state, cost, letters, turns):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows) and state in "0a" and (best is None or (cost, letters) < best[:2]):
            best = cost, letters, turns
        name = "assistant" if state == "u" else "user"
        if not letters.endswith("III"):
            go(k, name[0], cost + 2, letters + "I", [*turns, (name, "")])
        if k == len(rows):
            return
        role, text, fault = rows[k]
        go(k + 1, state, cost + 3, letters + "D", turns)
        if fault in ("blank", "duplicate"):
            return
        more = fault == "truncated"
        if role[:1] == name[0] or state == "0" and role[:1] == "s":
            go(k + 1, role[:1], cost + more, letters + "K", [*turns, (role, text)])
        go(k + 1, name[0], cost + 2 + more, letters + "R", [*turns, (name, text)])

    go(0, "0", 0, "", [])
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        stem = text.strip(SPACE)
        out.append((role, text, "blank" if not stem else "duplicate" if (role, text) in seen else "truncated" if stem[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def brute_audit(rows):
    """Of damaged rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    known, turns = faults([r[1:] for r in rows]), [r[0] for r in rows if r[0] is not None]
    count = lambda kind: sum(f == kind for *_, f in known)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, letters, repaired = all_repairs(known)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, letters, sha("\n".join(f"{r}:{t}" for r, t in repaired))


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine, role, text = out.setdefault(conv, []), " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_repairs(spark):
    rng = random.Random(11)
    rows = []
    for conv in [None, *range(150)]:
        for _ in range(rng.choice([1, 2, 4, 7])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "user "])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, -4]), role, rng.choice([None, "", " \t\n", "Yes.", "no", "Why?! \r\n", "é" * 3, "x" * 5000 + "!", " "])))
    df = spark.createDataFrame(rows, CHATS).repartition(3)
    clash = df.selectExpr("*", "1 AS fault", "2 AS __nth", "3 AS edit")
    got = {r["conv_id"]: tuple(r)[1:] for r in structure_repair.audit(structure_repair.damaged(clash), clash).collect()}
    assert got == {conv: brute_audit(mine) for conv, mine in brute_damage(rows).items()}
    assert structure_repair.audit(structure_repair.damaged(df.limit(0)), df.limit(0)).collect() == []
    edits = structure_repair.repair(df).collect()
    assert sum(e["edit"] != "I" for e in edits) == len(rows) and all((e["text"] is None) == (e["edit"] == "D") for e in edits)


def test_decoder_settles_early():
    """Edits come out while rows go in; what is held back doesn't grow with an orderly conversation."""
    decoder, out = Decoder(), []
    for k in range(20_000):
        out += decoder.read((k, ("user", "assistant")[(k + k // 997) % 2], "t", None))
        assert k - len(out) < 8
    decoder, out = Decoder(), []
    for k in range(20_000):  # nothing says where the user's turns are: all is open to the end, at the same cost a row
        out += decoder.read((k, "tool", "t", None))
    assert not out and "".join(e[0] for e in decoder.end()) == "R" * 20_000


def test_all_short_conversations():
    kinds = [(role, fault) for role in ("system", "user", "assistant", "tool") for fault in (None, "blank", "truncated")]
    rng = random.Random(3)
    for n in range(6):
        for _ in range(150):
            rows = [(role, f"t{k}", fault) for k, (role, fault) in enumerate(rng.choice(kinds) for _ in range(n))]
            decoder, out = Decoder(), []
            for k, (role, text, fault) in enumerate(rows):
                out += decoder.read((k, role, text, fault))
            out += decoder.end()
            got = sum(e[3] for e in out), "".join(e[0] for e in out), [(e[2], e[1][2] if e[1] else "") for e in out if e[2] is not None]
            assert got == all_repairs(rows)


# Prefix trie


def turns_of(rows):
    own = {}
    for conv, turn, role, text in rows:
        own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [r[2:] for r in sorted(v)] for c, v in own.items()}


def rebuild(own):
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if c is not None else 0
        base = own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), []) if c is not None else []  # the rest has the sign of c
        out[c] = base[:h] + mine[h:]
    return out


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    least = {node: min((c for c in m if c is not None), default=None) for node, m in members.items()}
    out = []
    for node, m in members.items():
        under = [x for x in members if x[: len(node)] == node]
        children = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(map(str, sorted(c for c in m if c is not None and len(convs[c]) == len(node))))
        out.append((least[node], len(node), least[node[:-1]] if node else None, len(m), len(children), len(leaves), saved, sha(ends)))
    return sorted(out, key=str)


def chats(rng, n):
    rows = []
    for c in [None, *rng.sample(range(-40, 400), n)]:
        same = rng.random() < 0.3  # a third are copies of one conversation
        for t in range(3 if same else rng.choice([1, 1, 2, 4, 12])):
            rows.append((c, None if rng.random() < 0.03 else t, None if rng.random() < 0.05 else "user", f"hot{t}" if same else rng.choice(["a", "b", None, "é" * t])))
    return rows


@pytest.mark.parametrize("shards", [1, 7, 30])
def test_trie(spark, shards):
    rows = chats(random.Random(shards), 130) + [(7, 0, "user", "dup")] * 2 + [(401, k, "user", "z" * 70 + str(k % 2)) for k in range(300)] + [(406, k, "user", "z" * 70 + str(k % 2)) for k in range(290)]
    df = spark.createDataFrame(rows, CHATS).selectExpr("*", "1 AS path", "2 AS depth").repartition(3)
    for convs, made in ((turns_of(rows), prefix_trie.paths(df)), (rebuild(turns_of(rows)), prefix_trie.rebuilt_paths(df))):
        got = prefix_trie.prefix_trie(made, shards, held=HELD if shards < 30 else 0)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(convs)


def test_trie_edges(spark):
    df = spark.createDataFrame([], CHATS)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt_paths(df)).collect() == [] and prefix_trie.prefix_trie(prefix_trie.paths(df)).collect() == []
    copies = spark.createDataFrame([(c, t, "user", f"same{t}") for c in range(300) for t in range(3)], CHATS)
    got = prefix_trie.prefix_trie(prefix_trie.paths(copies), 16)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_trie(turns_of(map(tuple, copies.collect()))), key=lambda r: r[1])
    shards = prefix_trie.paths(copies).repartitionByRange(16, "path", "conv_id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in shards.collect()) < 60  # copies of one path fill many shards
    shown = prefix_trie.with_turns(got, copies).orderBy("depth").collect()
    assert [(r["role"], r["text"]) for r in shown] == [(None, None), ("user", "same0"), ("user", "same1"), ("user", "same2")]
    lost = spark.createDataFrame([(3, 0, "user", "own")], CHATS)  # its first turns are to come from 0, which isn't there
    assert [tuple(r)[:2] for r in prefix_trie.prefix_trie(prefix_trie.rebuilt_paths(lost)).collect()] == ([(3, 0)] if zlib.crc32(b"3") % 9 else [(3, 0), (3, 1)])


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_structure_repair", "op12_prefix_trie"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = db.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str, queries.QUERIES[name](spark, SF).select(*names).collect())) == sorted(str(spark_row(names, r)) for r in want.fetchall())


def spark_row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values, strict=True)))
