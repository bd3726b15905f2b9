"""Conversation structure repair: the cheapest edits by a dynamic programme over persistent audits.

A repaired conversation has no rows, or a system row if any and then turns of
user and assistant. Rows are kept, reroled, deleted or inserted; the programme
walks the rows of a conversation once and holds, for every state of that
pattern, the cheapest edits so far. Edits are a chain of nodes that share their
prefixes: a node has its letter, depth, a rolling hash of all letters before it
and its ancestors at powers of two. Of two equally cheap chains the smaller one
is found from their longest common prefix, by lifting both while the hashes
differ; a prefix that is equal by hash only is walked letter by letter.

Neither texts nor settled edits are held: every state carries the digest of
its repaired rows, and edits that all states share are moved out of the chain.
So a conversation is read once, as a sorted stream, whatever its length; what
grows is its audit, which is part of the result. The digest of a conversation
is one running hash, so one conversation cannot be divided between tasks.

Defined results: a null role or text is one space, a null conversation is one
conversation, null turns come first and are left out of gaps; rows with the
same turn go by role, then text; repeated rows are duplicates; a role is known
by its first letter; a conversation without rows has zeros and an empty audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import utf8

SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Pattern states: nothing yet, a system row, after a user row, after an assistant row.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: (state, role letter) to state; the two ends are NONE and ASSISTANT.
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
#: Nodes after which the edits that all states share leave the chain.
SETTLE = 2_000
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Chain:
    """Edit prefixes as linked nodes; node 0 is the empty prefix."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[0]]

    def add(self, parent: int, letter: str) -> int:
        """The node of the prefix `parent` with one more letter."""
        node = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % _MOD)
        up, k = [parent], 0
        while k < len(self.up[up[k]]) and up[k]:        # 1, 2, 4, … letters back
            up.append(self.up[up[k]][k])
            k += 1
        self.up.append(up)
        return node

    def lift(self, node: int, depth: int) -> int:
        """The ancestor of a node at a depth."""
        while (rest := self.depth[node] - depth) > 0:
            node = self.up[node][min(rest.bit_length(), len(self.up[node])) - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth have the same hash."""
        return a == b or self.hash[a] == self.hash[b]

    def text(self, node: int, root: int = 0) -> str:
        """Letters from below `root` to a node."""
        out = []
        while node != root:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def less(self, a: int, b: int) -> bool:
        """Whether the prefix of node a is smaller than that of b."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if not self.same(x, y):
            for k in reversed(range(max(1, self.depth[x].bit_length()))):
                if k < len(self.up[x]) and k < len(self.up[y]):
                    p, q = self.up[x][k], self.up[y][k]
                    if not self.same(p, q):
                        x, y = p, q
            p, q = self.up[x][0], self.up[y][0]     # the longest common prefix, by hash
            if p == q:
                return self.letter[x] < self.letter[y]
        else:
            p, q = x, y
        if p != q:      # equal by hash, other nodes: the letters decide
            s, t = self.text(p), self.text(q)
            if s != t:
                return s < t
        if x == p:
            return self.depth[a] < self.depth[b]
        return self.letter[x] < self.letter[y]

    def settle(self, nodes: list[int]) -> tuple[str, list[int]]:
        """Letters that all nodes share, which leave the chain, and the new numbers of the nodes."""
        depth = min(self.depth[n] for n in nodes)
        at = {self.lift(n, depth) for n in nodes}
        while len(at) > 1:
            at = {self.up[n][0] for n in at}
        root = at.pop()
        tails = [self.text(n, root) for n in nodes]
        shared = self.text(root)
        known: dict[tuple[int, str], int] = {}
        self.__init__()
        out = []
        for tail in tails:      # common beginnings stay common nodes
            node = 0
            for letter in tail:
                if (found := known.get((node, letter))) is None:
                    found = known[node, letter] = self.add(node, letter)
                node = found
            out.append(node)
        return shared, out


class Repair:
    """Counts faults and finds the cheapest edits of the rows of one conversation, given in order."""

    def __init__(self) -> None:
        self.chain, self.done, self.limit = Chain(), [], SETTLE
        # state: (cost, node, digest of the repaired rows so far)
        self.best: dict[int, tuple[int, int, object]] = {NONE: (0, 0, hashlib.sha256())}
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.low: int | None = None
        self.high: int | None = None
        self.turns = 0

    def _better(self, found: dict, state: int, cost: int, node: int, digest, more: tuple) -> None:
        """Keeps the cheaper way into a state, of equally cheap ones the smaller."""
        old = found.get(state)
        if old is None or cost < old[0] or (cost == old[0] and self.chain.less(node, old[1])):
            found[state] = (cost, node, digest, more)

    def _inserted(self) -> dict[int, tuple]:
        """The best ways into every state with none, one or two rows inserted; more only come back to a state."""
        found: dict[int, tuple] = {}
        for state, (cost, node, digest) in self.best.items():
            more: tuple = ()
            for _ in range(3):
                self._better(found, state, cost, node, digest, more)
                role = "a" if state == USER else "u"
                state, cost, node, more = NEXT[state, role], cost + INSERT, self.chain.add(node, "I"), (*more, f"{NAMES[role]}:")
        return found

    @staticmethod
    def _written(digest, state_was_empty: bool, more: tuple):
        """The digest with more rows."""
        if not more:
            return digest
        digest = digest.copy()
        for k, row in enumerate(more):
            digest.update(utf8(row if state_was_empty and k == 0 else "\n" + row))
        return digest

    def row(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        """The next row; `seen`: an earlier one has the same role and text."""
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        shown = text.rstrip(SPACE)
        blank, cut = not shown, bool(shown) and shown[-1] not in STOPS
        if blank:
            self.blank += 1
        elif seen:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial

        found: dict[int, tuple] = {}
        extra = CUT if cut else 0
        for state, (cost, node, digest, more) in self._inserted().items():
            self._better(found, state, cost + DELETE, self.chain.add(node, "D"), digest, more)
            if blank or seen:
                continue
            if (to := NEXT.get((state, initial))) is not None:
                self._better(found, to, cost + KEEP + extra, self.chain.add(node, "K"), digest, (*more, f"{role}:{text}"))
            new = "a" if state == USER else "u"
            self._better(found, NEXT[state, new], cost + REROLE + extra, self.chain.add(node, "R"), digest,
                         (*more, f"{NAMES[new]}:{text}"))
        self.best = self._pruned(found)
        if len(self.chain.letter) > self.limit:
            shared, nodes = self.chain.settle([v[1] for v in self.best.values()])
            self.done.append(shared)
            self.best = {s: (c, n, d) for (s, (c, _, d)), n in zip(self.best.items(), nodes, strict=True)}
            self.limit = max(SETTLE, 2 * len(self.chain.letter))

    def _pruned(self, found: dict) -> dict:
        """Without states from which every end is dearer than from another, with digests written."""
        a, u = (found[s][0] if s in found else None for s in (ASSISTANT, USER))
        out = {}
        for state, (cost, node, digest, more) in found.items():
            # From ASSISTANT all that follows NONE, but for a system row, and SYSTEM is possible too.
            worse = a is not None and a + {NONE: DELETE, SYSTEM: 0, USER: INSERT, ASSISTANT: 0}[state] < cost
            if not (worse or (u is not None and state == ASSISTANT and u + INSERT < cost)):
                out[state] = (cost, node, self._written(digest, self._nothing(digest), more))
        return out

    def _nothing(self, digest) -> bool:
        """Whether a digest is of no rows: only NONE has it."""
        return NONE in self.best and digest is self.best[NONE][2]

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        end = None
        for state, (cost, node, digest, more) in self._inserted().items():
            if state in (NONE, ASSISTANT) and (end is None or cost < end[0] or (cost == end[0] and self.chain.less(node, end[1]))):
                end = (cost, node, digest, more)
        cost, node, digest, more = end
        digest = self._written(digest, self._nothing(digest), more)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost,
                "".join([*self.done, self.chain.text(node)]), digest.hexdigest())


# --- jobs --------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy of every row with its fault, by the checksum of its place; a dropped row stays as `gone`."""
    def said(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    r = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("f"))
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return r.select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(copies).alias("copy"), (F.col("f") == 0).alias("gone"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by conversation, in order within it; one shuffle serves the search for duplicates and the order."""
    rows = rows.repartition("conv_id")
    w = Window.partitionBy("conv_id", "role", "text", "gone").orderBy("turn", "copy")
    return rows.withColumn("seen", F.row_number().over(w) > 1).sortWithinPartitions("conv_id", "turn", "role", "text", "copy")


def _with_defaults(rows: DataFrame) -> DataFrame:
    """Conversation rows as the programme takes them: nulls become spaces; no copies, nothing gone."""
    cols = set(rows.columns)
    return rows.select(
        "conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")),
        (F.col("copy") if "copy" in cols else F.lit(0)).alias("copy"), (F.col("gone") if "gone" in cols else F.lit(False)).alias("gone"))


RESULTS = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long",
           "audit": "string", "repaired_sha256": "string"}


def audit(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): its faults and its cheapest edits.

    With a boolean column `gone`, rows marked so only name their conversation.
    """
    src = _ordered(_with_defaults(rows))
    ddl = ", ".join([f"conv_id {rows.schema['conv_id'].dataType.simpleString()}", *(f"{k} {v}" for k, v in RESULTS.items())])
    kind = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv, ids, out, id_type = None, None, [], [], None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            b = pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, t in zip(cols, kind, strict=True))],
                                           ["conv_id", *RESULTS])
            ids.clear()
            out.clear()
            return b

        for b in batches:
            id_type = b.schema.field("conv_id").type
            for c, turn, role, text, gone, seen in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "gone", "seen")), strict=True):
                if open_ is None or c != conv:
                    if open_ is not None:
                        ids.append(conv)
                        out.append(open_.result())
                    open_, conv = Repair(), c
                if not gone:
                    open_.row(turn, role, text, seen)
            if out:
                yield flush()
        if open_ is not None:
            ids.append(conv)
            out.append(open_.result())
            yield flush()

    return src.mapInArrow(run, ddl)


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the rows that the audits make of `rows`.

    The audit of a conversation goes ahead of its rows in one sorted stream.
    """
    marks = ["conv_id", "turn", "role", "text", "copy", "gone"]
    src = _with_defaults(rows).where(~F.col("gone")).select(*marks, F.lit(1).alias("kind"))
    head = audits.select("conv_id", F.lit(None).cast(src.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
                         F.col("audit").alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("gone"), F.lit(0).alias("kind"))
    src = src.unionByName(head).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text", "copy")
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, state, place = "", 0, NONE, 0
        for b in batches:
            out: list[tuple] = []

            def put(c, role: str, text: str) -> None:
                nonlocal state, place
                state = NEXT[state, role[:1]]
                out.append((c, place, role, text))
                place += 1

            def inserts(c) -> None:
                nonlocal at
                while at < len(edits) and edits[at] == "I":
                    put(c, NAMES["a" if state == USER else "u"], "")
                    at += 1

            for c, kind, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "kind", "role", "text")), strict=True):
                if kind == 0:
                    edits, at, state, place = text, 0, NONE, 0
                else:
                    edit, at = edits[at], at + 1
                    if edit == "K":
                        put(c, role, text)
                    elif edit == "R":
                        put(c, NAMES["a" if state == USER else "u"], text)
                inserts(c)
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("conv_id").type), pa.array(cols[1], pa.int64()),
                                                  pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["conv_id", "place", "role", "text"])

    return src.mapInArrow(run, ddl)


def op12_conversations(rows: DataFrame) -> DataFrame:
    """Every conversation after its damage: faults, cost and audit of the repair, digest of the repaired rows."""
    return audit(damaged(rows))
