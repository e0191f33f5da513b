"""Repair of the order of roles in conversations, by a Viterbi decoder that writes while it reads.

A whole conversation is `(system? (user assistant)+)?` by the roles' initials. Its rows' faults are found first: blank
(nothing but space, tab and line breaks), duplicate (role and text as in an earlier row), truncated (doesn't end in
".", "!" or "?"). Edits then make the order whole at the least cost: keep a row (0), give it another role (2), delete it
(3; blank and duplicate rows have to go), insert an empty turn (2); a truncated row that stays costs 1. Of repairs that
cost the same, the one whose edits' initials (D, I, K, R) come first as a string is taken.

1. Rows are shuffled once, by conversation. A window marks duplicates and a sort puts the rows in order; both spill.
2. A task reads its rows as a stream. For each state (nothing yet, system, user, assistant) one survivor is kept: the
   best way to get there. Survivors are leaves of a tree of backpointers with reference counts: a survivor that isn't
   continued gives its branch back, chains are joined into one node, and as soon as all survivors share an ancestor,
   the edits up to it are written and forgotten. A survivor that can no longer win against another, whatever follows,
   is dropped. So memory holds the part on which survivors differ, not the conversation; Python's part of the work is
   a few steps a row, however long the part is.
3. Survivors of one cost are compared by their whole strings back to where they part. In the tree, branches of a node
   begin with different letters, so that the letters after the last common node decide, and neither is cut short.

A conversation's digest needs its rows in order, so one conversation is read by one task, as a stream.

Defined results: null roles and texts are one space, so that a null text is blank. Rows of one turn are ordered by role
and text; null turns come first and don't count as gaps. Repeated rows are duplicates. Rows of a null conv_id form one
conversation. A conversation without rows has zeros and empty strings. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, REPLY = range(4)
USERS, REPLIES = "user", "assistant"
#: A state's next one by a role's initial.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (REPLY, "u"): USER, (USER, "a"): REPLY}
#: The role that an edited or inserted turn has in a state, and the state after it.
GIVEN = {START: (USERS, USER), SYSTEM: (USERS, USER), REPLY: (USERS, USER), USER: (REPLIES, REPLY)}
EDITS = "conv_id long, nth long, edit string, turn long, was string, fault string, cost long, role string, text string"


def crc(*parts: Column) -> Column:
    """CRC-32 of the parts' text with ":" between them; a null is one space."""
    return F.crc32(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit(" ")) for p in parts)).cast("binary"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by hash: of 20 rows, one is dropped, emptied, without its ends of
    sentences, repeated, and the user's."""
    kind = F.pmod(crc(col("conv_id"), col("turn")), F.lit(20))
    text = F.coalesce(col("text"), F.lit(" "))
    own = rows.select(
        col("conv_id").cast("long").alias("conv_id"), col("turn").cast("long").alias("turn"),
        F.when(kind == 4, USERS).otherwise(F.coalesce(col("role"), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("__copies"), kind.alias("__kind"),
    )
    return own.filter("__kind <> 0").withColumn("__copy", F.explode("__copies")).select("conv_id", "turn", "role", "text")


def in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault), whole conversations in each partition, in order."""
    own = rows.select(col("conv_id").cast("long").alias("conv_id"), col("turn").cast("long").alias("turn"), *(F.coalesce(col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(order[0]))
    ends = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(F.translate("text", BLANKS, "") == "", "blank").when(F.col("__nth") > 1, "duplicate").when(~ends.isin(".", "!", "?"), "truncated")
    marked = own.repartition("conv_id").withColumn("__nth", nth).withColumn("fault", fault)
    return marked.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order, "__nth").drop("__nth")


class Node:
    """A stretch of edits in the tree of backpointers. uses: how many nodes and survivors hang on it."""

    __slots__ = ("edits", "parent", "uses")

    def __init__(self, parent: Node | None, edit: tuple | None = None):
        self.edits, self.parent, self.uses = deque([edit] if edit else []), parent, 0
        if parent:
            parent.uses += 1


class Decoder:
    """The edits of one conversation. An edit is (initial, row or None, role after it, cost); a row is (turn, role, text, fault)."""

    def __init__(self) -> None:
        self.root = Node(None)
        self.ways: dict[int, tuple[int, Node]] = {}
        self._survive({START: (0, self.root, None)})
        self._insert()

    def read(self, row: tuple) -> Iterator[tuple]:
        """The edits that are settled with this row."""
        _, role, _, fault = row
        cost = TRUNCATED if fault == "truncated" else 0
        found: dict[int, tuple[int, Node, tuple]] = {}
        for state, (spent, node) in self.ways.items():
            self._offer(found, state, spent + DELETE, node, ("D", row, None, DELETE))
            if fault in ("blank", "duplicate"):
                continue
            kept = NEXT.get((state, role[:1]))
            if kept is not None:
                self._offer(found, kept, spent + cost, node, ("K", row, role, cost))
            given, after = GIVEN[state]
            self._offer(found, after, spent + REROLE + cost, node, ("R", row, given, REROLE + cost))
        self._survive(found)
        self._insert()
        return self._settled()

    def end(self) -> list[tuple]:
        """The edits that were left open, once no row follows."""
        found: dict[int, tuple[int, Node, None]] = {}
        for state in (START, REPLY):
            if state in self.ways:
                self._offer(found, START, *self.ways[state], None)
        out: list[tuple] = []
        node: Node | None = found[START][1]
        while node is not self.root:
            out[:0] = node.edits
            node = node.parent
        return out

    def _offer(self, found: dict, state: int, cost: int, node: Node, edit: tuple | None) -> None:
        """Takes node and then edit as the way to state if it is cheaper, or costs the same and comes first."""
        best = found.get(state)
        if best is None or cost < best[0] or cost == best[0] and self._before(node, edit, best[1], best[2]):
            found[state] = cost, node, edit

    @staticmethod
    def _before(a: Node, last_a: tuple | None, b: Node, last_b: tuple | None) -> bool:
        """Whether the whole string of edits up to a and last_a comes before that of b."""
        ups = []
        for node in (a, b):
            up = []
            while node is not None:
                up.append(node)
                node = node.parent
            ups.append(up[::-1])
        k = 0
        while k < min(map(len, ups)) and ups[0][k] is ups[1][k]:
            k += 1
        parts = [up[k].edits[0][0] if k < len(up) else (last[0] if last else "") for up, last in zip(ups, (last_a, last_b), strict=True)]
        return parts[0] < parts[1]

    def _insert(self) -> None:
        """Ways that end in inserted turns: to USER, and from there to REPLY."""
        for to, sources in ((USER, (START, SYSTEM, REPLY)), (REPLY, (USER,))):
            found: dict[int, tuple[int, Node, tuple | None]] = {s: (*way, None) for s, way in self.ways.items()}
            for source in sources:
                if source in self.ways:
                    cost, node = self.ways[source]
                    self._offer(found, to, cost + INSERT, node, ("I", None, GIVEN[source][0], INSERT))
            self._survive(found)
        # From REPLY all goes on that could from the others, once a system turn is deleted; from USER after an insert.
        least = min(self.ways[s][0] + extra for s, extra in ((REPLY, 0), (USER, INSERT)) if s in self.ways)
        for state, extra in ((START, DELETE), (SYSTEM, 0)):
            if state in self.ways and self.ways[state][0] > least + extra:
                self._release(self.ways.pop(state)[1])

    def _survive(self, found: dict[int, tuple[int, Node, tuple | None]]) -> None:
        """found's ways, each a node and an edit after it or none, in place of those before."""
        before = [node for _, node in self.ways.values()]
        self.ways = {}
        for state, (cost, node, edit) in found.items():
            node = Node(node, edit) if edit else node
            node.uses += 1
            self.ways[state] = cost, node
        for node in before:
            self._release(node)

    def _release(self, node: Node | None) -> None:
        node.uses -= 1
        while not node.uses and node.parent is not None:
            node = node.parent
            node.uses -= 1

    def _settled(self) -> Iterator[tuple]:
        """Joins chains without branches, and gives out the edits that all survivors share."""
        for _, node in self.ways.values():
            while (up := node.parent) is not None:
                if up.uses > 1:
                    node = up
                elif up is self.root:
                    yield from node.edits
                    node.edits.clear()
                    node.parent, self.root = None, node
                else:  # the shorter side is moved
                    if len(up.edits) > len(node.edits):
                        up.edits.extend(node.edits)
                        node.edits = up.edits
                    else:
                        node.edits.extendleft(reversed(up.edits))
                    node.parent = up.parent


def repair(rows: DataFrame) -> DataFrame:
    """Of rows (conv_id, turn, role, text): the edits of each conversation, in order inside its partition. Columns: conv_id,
    nth, edit (K, R, D, I), the row's turn, role before (`was`) and fault, cost, and the turn's role and text after it
    (null: deleted)."""
    names = [c.split()[0] for c in EDITS.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in EDITS.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, conv, nth, out, size = None, None, 0, [], 0

        def take(edits: Iterator[tuple]) -> None:
            nonlocal nth, size
            for edit, row, role, cost in edits:
                turn, was, text, fault = row or (None, None, "", None)
                out.append((conv, nth, edit, turn, was, fault, cost, role, None if role is None else text))
                nth += 1
                size += 100 + len(text)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return made

        for part in batches:
            for c, *row in zip(*(part.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                if decoder is None or c != conv:
                    if decoder:
                        take(decoder.end())
                    decoder, conv, nth = Decoder(), c, 0
                take(decoder.read(tuple(row)))
                if size > 4_000_000:
                    yield batch()
                    size = 0
        if decoder:
            take(decoder.end())
        if out:
            yield batch()

    return in_order(rows).mapInArrow(decode, EDITS)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(edits: DataFrame) -> DataFrame:
    """A row per conversation of repair()'s edits: its gaps, faults and illegal steps before, and the repair's cost, letters
    and digest. It reads the edits as they come, in order."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in SUMMARY.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own, out = None, None, []

        def close() -> None:
            first, last, turns = own["turns"]
            gaps = last - first + 1 - turns if turns else 0
            out.append((conv, gaps, *(own[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(own["audit"]), own["sha"].hexdigest()))

        for part in batches:
            columns = (part.column(k).to_pylist() for k in ("conv_id", "nth", "edit", "turn", "was", "fault", "cost", "role", "text"))
            for c, nth, edit, turn, was, fault, cost, role, text in zip(*columns, strict=True):
                if not nth:
                    if own:
                        close()
                    conv, own = c, {"turns": (0, 0, 0), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "last": None, "any": False}
                own["audit"].append(edit)
                own["cost"] += cost
                if fault:
                    own[fault] += 1
                if edit != "I":
                    own["illegal"] += own["last"] is not None and own["last"] + was[:1] not in ("su", "ua", "au")
                    own["last"] = was[:1]
                    first, last, turns = own["turns"]
                    if turn is not None and (not turns or turn != last):
                        own["turns"] = (first if turns else turn, turn, turns + 1)
                if role is not None:
                    own["sha"].update(f"{chr(10) * own['any']}{role}:{text}".encode())
                    own["any"] = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out.clear()
        if own:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return edits.mapInArrow(digest, SUMMARY)


def audit(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """summaries() of the repair of rows, and zeros and empty strings for each other conv_id of ids."""
    found = summaries(repair(rows)).withColumnRenamed("conv_id", "__conv")
    every = ids.select(col("conv_id").cast("long").alias("conv_id")).distinct()
    met = every.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return met.select("conv_id", *(F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns[1:]))
