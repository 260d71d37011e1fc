"""Conversation structure repair: the cheapest edits that make a conversation legal, with their audit.

A legal conversation has role initials ``(s?(ua)+)?``: an optional system turn, then user and
assistant by turns, or nothing at all. Edits: keep a row (K, 0), give it the role user or assistant
(R, 3), delete it (D, 4; blank and duplicate rows must go), insert a user or assistant row without
text anywhere (I, 3); a truncated row that stays adds 3. Among the cheapest edits those whose
letters, in order, are least in ASCII win, which also fixes every role.

Persistent audit DP: rows are folded one by one over four states (nothing yet, after system, user,
assistant), each with its least cost and its audit. Audits that share a beginning share it as linked
nodes with binary-lifting ancestors and rolling hashes of everything from the first letter on. Equal
costs are settled by searching the longest common prefix over the ancestors; the prefix found by
hashes is then compared letter by letter down to the next shared node, and a collision falls back to
comparing the letters themselves. Of two equally dear audits over the same rows neither begins the
other (the longer one would have paid for its extra inserts), so the order of the prefixes holds for
whatever follows. Once all four states share a first stretch, its edits are final: they leave the
task and their nodes and rows are forgotten, so a long conversation streams through.

Faults are found with window functions before the fold; rows are shuffled once, by conversation.
The fold and the digest of a conversation go through its rows in order, as its one sha256 demands:
a conversation is the unit of work, and one conversation of all rows is one task's stream of bounded
memory (beside rows that stay undecided and the audit itself).

Defined cases: a null role or text is one space (so such a text is blank, such a role starts
nothing); a null turn comes first and counts for no gap; rows of one turn come by role and text;
null conversation ids are one conversation; rows marked ``present`` = false only name their
conversation, one without other rows has no edits; extra columns are ignored; repeated rows are
duplicates; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANKS = " \t\n\x0b\x0c\r"
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAULTS = ("", "blank", "duplicate", "truncated")
#: States of the fold: what the last row that stays is.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after a user or assistant row; an assistant must follow a user, a user anything else.
TURN = {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL_PAIRS = {"su", "ua", "au"}
#: Nodes after which the audits are looked through for a settled beginning.
NODES = 1 << 15
BASE, PRIME = 0x1F3D5B79ACE13, (1 << 61) - 1

EDITS = ("conv_id long, step long, edit string, fault string, turn long, role_before string, "
         "role string, text string")


# --- faults -------------------------------------------------------------------------------------

def blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS)) == ""


def truncated(text: Column) -> Column:
    return ~F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present, fault``, one conversation to a partition, in order."""
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.coalesce(present, F.lit(True)).alias("present"))
    same = (Window.partitionBy("conv_id", "present", "role", F.sha2("text", 256))
            .orderBy(F.col("turn").asc_nulls_first()))
    seen = plain.repartition("conv_id").withColumn("nth", F.row_number().over(same))
    return (seen.withColumn("fault", F.when(blank(F.col("text")), 1).when(F.col("nth") > 1, 2)
                            .when(truncated(F.col("text")), 3).otherwise(0))
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth")
            .drop("nth"))


# --- audits as linked nodes -----------------------------------------------------------------------

class Audits:
    """A tree of letters. Node 0 is the empty audit; every other node adds one letter to its parent."""

    def __init__(self):
        self.letter, self.depth, self.mark, self.up = [""], [0], [0], [[]]
        self.alias: dict[int, int] = {}

    def __len__(self) -> int:
        return len(self.letter)

    def add(self, parent: int, letter: str) -> int:
        node, up, k = len(self.letter), [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.mark.append((self.mark[parent] * BASE + ord(letter)) % PRIME)
        self.up.append(up)
        return node

    def lift(self, node: int, depth: int) -> int:
        """The ancestor of ``node`` at ``depth``."""
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def spell(self, node: int, root: int = 0) -> str:
        out = []
        while node != root:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _first(self, node: int) -> int:
        while node in self.alias:
            node = self.alias[node]
        return node

    def alike(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth spell the same letters; what was compared once is kept."""
        pairs = []
        while (x := self._first(a)) != (y := self._first(b)):
            if self.letter[a] != self.letter[b]:
                return False
            pairs.append((x, y))
            a, b = self.up[a][0], self.up[b][0]
        for x, y in pairs:
            if (x := self._first(x)) != (y := self._first(y)):
                self.alias[max(x, y)] = min(x, y)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit ``a`` comes before audit ``b`` in ASCII."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if self.mark[x] == self.mark[y]:
            if self.alike(x, y):
                return self.depth[a] < self.depth[b]
            return self.spell(a) < self.spell(b)
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.mark[self.up[x][k]] != self.mark[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self.alike(self.up[x][0], self.up[y][0]):
            return self.spell(a) < self.spell(b)
        return self.letter[x] < self.letter[y]

    def shared(self, nodes: list[int]) -> int:
        """The deepest node that all of ``nodes`` have as ancestor (or are)."""
        depth = min(self.depth[n] for n in nodes)
        nodes = [self.lift(n, depth) for n in nodes]
        if len(set(nodes)) == 1:
            return nodes[0]
        for k in range(len(self.up[nodes[0]]) - 1, -1, -1):
            if k < len(self.up[nodes[0]]) and len({self.up[n][k] for n in nodes}) > 1:
                nodes = [self.up[n][k] for n in nodes]
        return self.up[nodes[0]][0]

    def above(self, root: int, nodes: list[int]) -> tuple[Audits, list[int]]:
        """The part of the tree from ``root`` up to ``nodes``, as a tree of its own."""
        out, new = Audits(), {root: 0}
        for node in nodes:
            path = []
            while node not in new:
                path.append(node)
                node = self.up[node][0]
            for n in reversed(path):
                new[n] = out.add(new[self.up[n][0]], self.letter[n])
        return out, [new[n] for n in nodes]


class Fold:
    """Cheapest audits of one conversation's rows so far, by state."""

    def __init__(self):
        self.audits, self.limit = Audits(), NODES
        self.best: dict[int, tuple[int, int]] = {EMPTY: (0, 0)}
        self._inserts()

    def _offer(self, to: dict, state: int, cost: int, parent: int, letter: str) -> None:
        old = to.get(state)
        if old is not None and cost > old[0]:
            return
        node = self.audits.add(parent, letter)
        if old is None or cost < old[0] or self.audits.less(node, old[1]):
            to[state] = (cost, node)

    def _inserts(self) -> None:
        # In this order one round reaches everything that two inserts can; more than two never pay.
        for state in (EMPTY, SYSTEM, USER, ASSISTANT):
            if state in self.best:
                cost, node = self.best[state]
                self._offer(self.best, TURN[state], cost + INSERT, node, "I")

    def row(self, initial: str, fault: int) -> None:
        now: dict[int, tuple[int, int]] = {}
        extra = TRUNCATED if fault == 3 else 0
        kind = INITIAL.get(initial)
        for state, (cost, node) in self.best.items():
            if fault not in (1, 2):
                if kind == TURN[state] or (kind == SYSTEM and state == EMPTY):
                    self._offer(now, kind, cost + extra, node, "K")
                self._offer(now, TURN[state], cost + extra + RETYPE, node, "R")
            self._offer(now, state, cost + DELETE, node, "D")
        self.best = now
        self._inserts()
        # Whatever may follow an audit that is still empty or ends with the system row may also follow
        # one that ends with an assistant row (a system row kept there is deleted here instead).
        closed = self.best[ASSISTANT][0]
        if EMPTY in self.best and self.best[EMPTY][0] > closed + DELETE:
            del self.best[EMPTY]
        if SYSTEM in self.best and self.best[SYSTEM][0] > closed:
            del self.best[SYSTEM]

    def settled(self) -> str:
        """Letters on which all states agree, once the tree has grown; they are forgotten here."""
        if len(self.audits) < self.limit:
            return ""
        states = list(self.best)
        nodes = [self.best[s][1] for s in states]
        root = self.audits.shared(nodes)
        letters = self.audits.spell(root)
        self.audits, nodes = self.audits.above(root, nodes)
        self.best = {s: (self.best[s][0], n) for s, n in zip(states, nodes, strict=True)}
        self.limit = max(NODES, 2 * len(self.audits))
        return letters

    def end(self) -> tuple[int, str]:
        """Cost and (remaining) letters of the cheapest audit that ends a legal conversation."""
        found: dict[int, tuple[int, int]] = {}
        for state in (EMPTY, ASSISTANT):
            if state in self.best:
                cost, node = self.best[state]
                old = found.get(EMPTY)
                if old is None or cost < old[0] or (cost == old[0] and self.audits.less(node, old[1])):
                    found[EMPTY] = (cost, node)
        cost, node = found[EMPTY]
        return cost, self.audits.spell(node)


class _Conversation:
    """Rows whose edits are not settled yet; turns letters into edit rows."""

    def __init__(self, conv):
        self.conv, self.fold, self.rows, self.step, self.state = conv, Fold(), [], 0, EMPTY

    def edits(self, letters: str) -> Iterator[tuple]:
        used = 0
        for letter in letters:
            turn = before = None
            role, text, fault = "", "", 0
            if letter != "I":
                turn, before, text, fault = self.rows[used]
                role = before
                used += 1
            if letter in "IR":
                self.state = TURN[self.state]
                role = ROLE[self.state]
            elif letter == "K":
                self.state = INITIAL[role[0]]
            yield (self.conv, self.step, letter, FAULTS[fault], turn, before, role, text)
            self.step += 1
        del self.rows[:used]

    def add(self, turn, role: str, text: str, fault: int) -> Iterator[tuple]:
        self.rows.append((turn, role, text, fault))
        self.fold.row(role[:1], fault)
        letters = self.fold.settled()
        if letters:
            yield from self.edits(letters)

    def end(self) -> Iterator[tuple]:
        if not self.step and not self.rows:
            yield (self.conv, None, None, None, None, None, None, None)
        else:
            yield from self.edits(self.fold.end()[1])


def _edit_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    now = None
    for batch in batches:
        for conv, turn, role, text, present, fault in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present", "fault")),
                strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    yield from now.end()
                now = _Conversation(conv)
            if present:
                yield from now.add(turn, role, text, fault)
    if now is not None:
        yield from now.end()


_EDIT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("fault", pa.string()),
                          ("turn", pa.int64()), ("role_before", pa.string()), ("role", pa.string()),
                          ("text", pa.string())])


def _batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded text."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + sum(len(v) for v in row if isinstance(v, str))
        if weight > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)],
                                             schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def edits(rows: DataFrame) -> DataFrame:
    """One row per edit, in order inside its partition: ``conv_id, step, edit, fault, turn,
    role_before, role, text``. An insert has no turn and no role before; a conversation without rows
    has one row without a step. The repaired conversation is every row with an edit other than D."""
    return faults(rows).mapInArrow(lambda batches: _batched(_edit_rows(batches), _EDIT_SCHEMA), EDITS)


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, position, role, text``: the repaired conversations, positions from 0."""
    kept = edits(rows).where("edit <> 'D'")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("step")) - 1
    return kept.select("conv_id", place.cast("long").alias("position"), "role", "text")


# --- digests --------------------------------------------------------------------------------------

class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.first, self.last = conv, 0, None, None
        self.count = dict.fromkeys(FAULTS, 0)
        self.illegal = self.cost = 0
        self.before, self.letters, self.sha, self.any = None, [], hashlib.sha256(), False

    def add(self, edit, fault, turn, before, role, text) -> None:
        self.letters.append(edit)
        self.cost += {"K": 0, "R": RETYPE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            self.count[fault] += 1
            self.cost += TRUNCATED if fault == "truncated" and edit != "D" else 0
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
            initial = before[:1]
            self.illegal += self.before is not None and self.before + initial not in LEGAL_PAIRS
            self.before = initial
        if edit != "D":
            self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, self.count["blank"], self.count["duplicate"], self.count["truncated"],
                int(self.illegal), self.cost, "".join(self.letters), self.sha.hexdigest())


def _digest_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    now = None
    for batch in batches:
        for conv, step, *rest in zip(*(batch.column(c).to_pylist() for c in
                                       ("conv_id", "step", "edit", "fault", "turn", "role_before", "role", "text")),
                                     strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    yield now.row()
                now = _Digest(conv)
            if step is not None:
                now.add(*rest)
    if now is not None:
        yield now.row()


_DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
    ("repaired_sha256", pa.string())])


def report(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every
    conversation, read from its edits in the task that made them."""
    return edits(rows).mapInArrow(
        lambda batches: _batched(_digest_rows(batches), _DIGEST_SCHEMA),
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string")


# --- damage, for tests and the registered query --------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20 (null: one space): 0 drops the row (it only names
    its conversation), 1 empties the text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's."""
    def or_space(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    marked = conversations.select(F.col("conv_id").cast("long").alias("conv_id"),
                                  F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"),
                                  or_space("text").alias("text"), kind.alias("kind"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return (marked.select("*", copies.alias("copy"))
            .select("conv_id", "turn",
                    F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"),
                    (F.col("kind") != 0).alias("present")))
