"""The cheapest edits that make the roles of a conversation alternate, and an audit of its faults.

Rows are kept (cost 0), given another role (3), deleted (4; blank and repeated rows must be) or inserted
(3), so that the role initials are an optional s and pairs of u and a; a truncated row that stays
costs 3 more.  The roles a conversation may have so far are the four states of a small automaton
(nothing yet, after s, after u, after a), and edits are its weighted arcs.

The weighted automaton is determinised as far as conversations need it.  Rows are read from the last
to the first; the least costs to finish from each of the four states, less the least of them, are a
vector, and vectors are states.  Their differences are bounded (inserted and deleted rows lead from
any state to any other), so there are few, whatever the length.  Each (state, kind of row) is worked
out once and kept in a table with its cost; all conversations of a batch are scanned with that table at
once.  Backward, that is from the first row on, arcs are followed that are tight (their cost and
the cost to finish after them add up to the cost to finish before them), the ASCII-least letter first.
From a state a letter leads to one state only, so the first tight letters make the least audit.  These
steps are kept in a second table by (state after the row, kind of row, role state).

Conversations of up to LONG rows and LONG_BYTES pass through one shuffle, by conversation, and one
sort, and are repaired in batches.  Longer ones are split: rows get their places in the total order
from range partitions, repeats are found by the least place of each role and text, and segments of
SEGMENT places are scanned from every state at once.  What a segment does to states is a few hundred
numbers, so segments are put together by them; then each writes its own part of the audit and of
the result.  Only the SHA-256 of a whole conversation has to read its parts one after the other.

Defined results: a null role or text is one space, in the checksum also a null conv_id or turn; rows of
one turn are in the order of role, text and copy; an initial other than s, u and a is never kept; a
conversation without rows after damage, null conv_id included, has zeros, an empty audit and the hash
of an empty string.  Repeated rows are duplicates; an empty table gives an empty result.  Only conv_id, turn,
role and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import checkpoint, written
from storyloom.operators.ordering import with_place

#: Rows and bytes of text up to which a conversation is repaired in one piece.
LONG = 4096
LONG_BYTES = 16_000_000
SEGMENT = 4096
RECORDS = 2000

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, CUT, GONE = range(3)
#: The role states: nothing yet, after s, after u, after a. AFTER[state][initial] is the next state; FREE[state] the one after a row of any role.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
AFTER = [[AFTER_S, AFTER_U, None, None], [None, AFTER_U, None, None], [None, None, AFTER_A, None], [None, AFTER_U, None, None]]
FREE = [AFTER_U, AFTER_U, AFTER_A, AFTER_U]
ROLE = ["user", "user", "assistant", "user"]
#: Costs to finish after the last row, and the letters that do.
END, FINISH = (0, 6, 3, 0), ["", "II", "I", ""]
KINDS = 12
WHITE = " \t\n\x0b\x0c\r"


class Table:
    """The determinised automaton, as far as it is known."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = [END]
        self.number = {END: 0}
        self.next = np.full((64, KINDS), -1, np.int32)
        self.cost = np.zeros((64, KINDS), np.int64)
        self.step = np.full((64, KINDS, 4), -1, np.int32)
        self.letters: list[str] = []
        self.moved = np.full((64, KINDS, 4), -1, np.int8)
        self.named: dict[str, int] = {}

    def _more(self, size: int) -> None:
        while len(self.next) < size:
            self.next, self.step, self.moved = (np.concatenate([x, np.full_like(x, -1)]) for x in (self.next, self.step, self.moved))
            self.cost = np.concatenate([self.cost, np.zeros_like(self.cost)])

    @staticmethod
    def arcs(kind: int, state: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next state) of the edits that use up the row."""
        initial, fault = divmod(kind, 3)
        out = [("D", DELETE, state)]
        if fault != GONE:
            more = TRUNCATED if fault == CUT else 0
            if AFTER[state][initial] is not None:
                out.append(("K", KEEP + more, AFTER[state][initial]))
            out.append(("R", REROLE + more, FREE[state]))
        return out

    def costs_before(self, vector: tuple[int, ...], kind: int) -> list[int]:
        least = [min(cost + vector[to] for _, cost, to in self.arcs(kind, q)) for q in range(4)]
        for _ in range(4):
            least = [min(c, INSERT + least[FREE[q]]) for q, c in enumerate(least)]
        return least

    def grow(self, state: int, kind: int) -> None:
        """Work out one transition and its steps."""
        vector = self.vectors[state]
        before = self.costs_before(vector, kind)
        base = min(before)
        normal = tuple(c - base for c in before)
        if normal not in self.number:
            self.number[normal] = len(self.vectors)
            self.vectors.append(normal)
            self._more(len(self.vectors))
        self.next[state, kind], self.cost[state, kind] = self.number[normal], base
        for q in range(4):
            letters, at = "", q
            while True:
                tight = [(letter, to) for letter, cost, to in self.arcs(kind, at) if cost + vector[to] == before[at]]
                insert = INSERT + before[FREE[at]] == before[at]
                letter, to = min(tight, default=("Z", at))
                if insert and letter > "I":
                    letters, at = letters + "I", FREE[at]
                    continue
                letters, at = letters + letter, to
                break
            if letters not in self.named:
                self.named[letters] = len(self.letters)
                self.letters.append(letters)
            self.step[state, kind, q], self.moved[state, kind, q] = self.named[letters], at

    def read(self, states: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states before these rows, and what they cost."""
        to = self.next[states, kinds]
        if (to < 0).any():
            for state, kind in np.unique(np.stack([states, kinds], axis=1)[to < 0], axis=0).tolist():
                self.grow(state, kind)
            to = self.next[states, kinds]
        return to, self.cost[states, kinds]

    def close(self) -> int:
        """Work out all states that can follow; their number."""
        state = 0
        while state < len(self.vectors):
            for kind in range(KINDS):
                if self.next[state, kind] < 0:
                    self.grow(state, kind)
            state += 1
        return len(self.vectors)


@lru_cache(maxsize=1)
def closed() -> Table:
    """The whole automaton, with the same numbers in every task."""
    table = Table()
    table.close()
    return table


def scan(table: Table, kinds: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the state after each row, the cost) of conversations between these bounds, a place from the end at a time for all."""
    after = np.zeros(len(kinds), np.int64)
    length = np.diff(bounds)
    state, cost = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    live = np.argsort(-length, kind="stable")
    for back in range(1, int(length.max(initial=0)) + 1):
        live = live[: np.searchsorted(-length[live], -back, "right")]
        at = bounds[live + 1] - back
        after[at] = state[live]
        state[live], more = table.read(state[live], kinds[at])
        cost[live] += more
    return after, cost + np.array([v[START] for v in table.vectors], np.int64)[state]


def trace(table: Table, kinds: np.ndarray, after: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the letters of each row, the role state before it), following tight arcs for all conversations at once."""
    step, before = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
    length = np.diff(bounds)
    role = np.zeros(len(length), np.int64)
    live = np.argsort(-length, kind="stable")
    for place in range(int(length.max(initial=0))):
        live = live[: np.searchsorted(-length[live], -place - 1, "right")]
        at = bounds[live] + place
        before[at] = role[live]
        step[at] = table.step[after[at], kinds[at], role[live]]
        role[live] = table.moved[after[at], kinds[at], role[live]]
    return step, before


def rewritten(letters: str, state: int, role: str, text: str, out: list[str]) -> int:
    """Append the rows that these letters leave; the role state after them."""
    for letter in letters:
        if letter == "I":
            out.append(f"{ROLE[state]}:")
            state = FREE[state]
        elif letter == "R":
            out.append(f"{ROLE[state]}:{text}")
            state = FREE[state]
        elif letter == "K":
            out.append(f"{role}:{text}")
            state = AFTER[state][initial(role)]
    return state


def initial(role: str) -> int:
    found = "sua".find(role[:1]) if role else -1
    return found if found >= 0 else OTHER


LEGAL = np.zeros((4, 4), bool)
LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True


def faults(conversations: DataFrame) -> DataFrame:
    """The rows after damage: conv_id, turn, copy (-1: a dropped row), role, text, initial, fault (repeats are not known yet)."""
    spell = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(spell("conv_id"), F.lit(":"), spell("turn"))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), chance.alias("chance"))
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("chance").isin(0, 1), "").when(F.col("chance") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("chance") == 0, F.array(F.lit(-1))).when(F.col("chance") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    first = F.substring("role", 1, 1)
    code = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(end == "", GONE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)
    return rows.withColumn("initial", code.cast("int")).withColumn("fault", fault.cast("int"))


def order(rows: DataFrame) -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("copy")]


SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair_batch(table: Table, turn: pa.Array, role: list[str], text: list[str], code: np.ndarray, fault: np.ndarray, bounds: np.ndarray) -> list[list]:
    """The results of whole conversations, which are between the bounds."""
    blank = fault == GONE
    repeat = np.zeros(len(code), bool)
    for a, b in zip(bounds, bounds[1:]):
        seen = set()
        for i in range(a, b):
            row = (role[i], text[i])
            repeat[i] = row in seen
            seen.add(row)
    repeat &= ~blank
    kinds = code * 3 + np.where(repeat, GONE, fault)
    after, cost = scan(table, kinds, bounds)
    step, before = trace(table, kinds, after, bounds)
    legal = LEGAL[code[:-1], code[1:]]
    at = turn.fill_null(0).to_numpy(zero_copy_only=False)
    known = turn.is_valid().to_numpy(zero_copy_only=False)
    out = [[] for _ in NAMES]
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        turns = np.unique(at[a:b][known[a:b]])
        rows: list[str] = []
        letters, state = [], START
        for j in range(a, b):
            letters.append(table.letters[step[j]])
            state = rewritten(letters[-1], int(before[j]), role[j], text[j], rows)
        letters.append(FINISH[state])
        rewritten(FINISH[state], state, "", "", rows)
        values = (
            int(turns[-1]) - int(turns[0]) + 1 - len(turns) if len(turns) else 0,
            int(np.count_nonzero(blank[a:b])),
            int(np.count_nonzero(repeat[a:b])),
            int(np.count_nonzero((fault[a:b] == CUT) & ~repeat[a:b])),
            int(np.count_nonzero(~legal[a : b - 1])) if b - a > 1 else 0,
            int(cost[i]),
            "".join(letters),
            hashlib.sha256("\n".join(rows).encode()).hexdigest(),
        )
        for column, value in zip(out, values):
            column.append(value)
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations, of about RECORDS rows, from rows in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < RECORDS:
            continue
        rows = pa.Table.from_batches(held)
        ids = rows.column("conv_id").combine_chunks()
        last = ids[len(ids) - 1]
        cut = len(ids)
        while cut and ids[cut - 1].equals(last):  # a conversation has LONG rows at most here
            cut -= 1
        if cut:
            yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def repair_short(rows: DataFrame, partitions: int) -> DataFrame:
    def run(batches):
        table = Table()
        for rows in _whole(batches):
            ids = rows.column("conv_id").combine_chunks()
            new = np.ones(len(ids), bool)
            new[1:] = pa.compute.fill_null(pa.compute.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            new[1:] &= ~(null[1:] & null[:-1])
            first = np.flatnonzero(new)
            real = rows.column("copy").to_numpy() >= 0
            bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(real.astype(np.int64), first))])
            some = rows.filter(pa.array(real))
            columns = repair_batch(
                table,
                some.column("turn").combine_chunks(),
                some.column("role").to_pylist(),
                some.column("text").to_pylist(),
                some.column("initial").to_numpy().astype(np.int64),
                some.column("fault").to_numpy().astype(np.int64),
                bounds,
            )
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), *(pa.array(c, pa.int64() if i < 6 else pa.string()) for i, c in enumerate(columns))], ["conv_id", *NAMES])

    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")
    return dealt.sortWithinPartitions(*order(rows)).mapInArrow(run, f"conv_id {kind}, {SCHEMA}")


def passage(table: Table, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What these rows do to each state after them: (the state before, the cost, the role state after for each role state before)."""
    n = len(table.vectors)
    state, cost = np.arange(n), np.zeros(n, np.int64)
    after = np.zeros((len(kinds), n), np.int64)
    for i in range(len(kinds) - 1, -1, -1):
        after[i] = state
        cost += table.cost[state, kinds[i]]
        state = table.next[state, kinds[i]].astype(np.int64)
    role = np.tile(np.arange(4), (n, 1))
    for i, kind in enumerate(kinds.tolist()):
        role = table.moved[after[i][:, None], kind, role].astype(np.int64)
    return state, cost, role


def _segments(rows: DataFrame) -> DataFrame:
    """One row for each part of a conversation: counts, ends, and its passage."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(table):
        table = table.sort_by("place")
        code, fault = table.column("initial").to_numpy().astype(np.int64), table.column("fault").to_numpy().astype(np.int64)
        repeat = table.column("repeat").to_numpy(zero_copy_only=False)
        turns = table.column("turn").drop_null().to_numpy()
        state, cost, role = passage(closed(), code * 3 + np.where(repeat, GONE, fault))
        blank = fault == GONE
        values = [int(blank.sum()), int((repeat & ~blank).sum()), int(((fault == CUT) & ~repeat).sum()), int((~LEGAL[code[:-1], code[1:]]).sum()), int(code[0]), int(code[-1])]
        least, most = (int(turns[0]), int(turns[-1])) if len(turns) else (None, None)
        return pa.table(
            {
                "conv_id": table.column("conv_id").slice(0, 1),
                "segment": table.column("segment").slice(0, 1),
                **{name: pa.array([v], pa.int64()) for name, v in zip(("blank", "duplicate", "truncated", "illegal", "head", "tail"), values)},
                "least": pa.array([least], pa.int64()),
                "most": pa.array([most], pa.int64()),
                "turns": pa.array([len(np.unique(turns))], pa.int64()),
                "passage": pa.array([np.concatenate([state, cost, role.ravel()]).astype("<i8").tobytes()], pa.binary()),
            }
        )

    light = rows.select("conv_id", "segment", "place", F.col("turn").cast("long").alias("turn"), "initial", "fault", "repeat")
    return light.groupBy("conv_id", "segment").applyInArrow(run, f"conv_id {kind}, segment long, blank long, duplicate long, truncated long, illegal long, head long, tail long, least long, most long, turns long, passage binary")


def _composed(segments: DataFrame) -> DataFrame:
    """For each segment the state after it and the role state before it, with the counts of its conversation; segments of a conversation are few."""
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(table):
        table, automaton = table.sort_by("segment"), closed()
        n = len(automaton.vectors)
        passages = [np.frombuffer(b.as_py(), "<i8") for b in table.column("passage")]
        state, cost, after = 0, 0, []
        for p in reversed(passages):
            after.append(state)
            cost += int(p[n + state])
            state = int(p[state])
        after.reverse()
        role, before = START, []
        for p, a in zip(passages, after):
            before.append(role)
            role = int(p[2 * n + 4 * a + role])
        head, tail = table.column("head").to_numpy(), table.column("tail").to_numpy()
        least, most = table.column("least").to_pylist(), table.column("most").to_pylist()
        known = [(a, b) for a, b in zip(least, most) if a is not None]
        distinct = pa.compute.sum(table.column("turns")).as_py() - sum(a[1] == b[0] for a, b in zip(known, known[1:]))
        gaps = known[-1][1] - known[0][0] + 1 - distinct if known else 0
        sums = [pa.compute.sum(table.column(c)).as_py() for c in ("blank", "duplicate", "truncated", "illegal")]
        sums[3] += int((~LEGAL[tail[:-1], head[1:]]).sum())
        last = [False] * (len(after) - 1) + [True]
        whole = [gaps, *sums, cost + automaton.vectors[state][START]]
        return pa.table(
            {
                "conv_id": table.column("conv_id"),
                "segment": table.column("segment"),
                "after": pa.array(after, pa.int64()),
                "before": pa.array(before, pa.int64()),
                "last": pa.array(last),
                **{name: pa.array([v] * len(after), pa.int64()) for name, v in zip(NAMES, whole)},
            }
        )

    return segments.groupBy("conv_id").applyInArrow(run, f"conv_id {kind}, segment long, after long, before long, last boolean, {SCHEMA.partition(', audit')[0]}")


def _parts(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Each segment's part of the audit and of the result."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(left, right):
        left, table = left.sort_by("place"), closed()
        info = right.to_pylist()[0]
        code, fault = left.column("initial").to_numpy().astype(np.int64), left.column("fault").to_numpy().astype(np.int64)
        kinds = code * 3 + np.where(left.column("repeat").to_numpy(zero_copy_only=False), GONE, fault)
        after, state = np.zeros(len(kinds), np.int64), info["after"]
        for i in range(len(kinds) - 1, -1, -1):
            after[i] = state
            state = int(table.next[state, kinds[i]])
        letters, out, role = [], [], info["before"]
        for a, k, name, text in zip(after.tolist(), kinds.tolist(), left.column("role").to_pylist(), left.column("text").to_pylist()):
            letters.append(table.letters[table.step[a, k, role]])
            role = rewritten(letters[-1], role, name, text, out)
        if info["last"]:
            letters.append(FINISH[role])
            rewritten(FINISH[role], role, "", "", out)
        values = {"audit": pa.array(["".join(letters)], pa.string()), "part": pa.array(["".join(x + "\n" for x in out)], pa.string())}
        return pa.table({"conv_id": left.column("conv_id").slice(0, 1), "segment": left.column("segment").slice(0, 1), **values, **{n: pa.array([info[n]], pa.int64()) for n in NAMES[:6]}})

    keys = ["conv_id", "segment"]
    return rows.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInArrow(run, f"conv_id {kind}, segment long, audit string, part string, {SCHEMA.partition(', audit')[0]}")


def repair_long(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = with_place(rows.where("copy >= 0"), order(rows)).withColumn("digest", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)).withColumn("segment", F.floor(F.col("place") / SEGMENT))
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first")).select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    known = written(placed.join(firsts, same).select("conv_id", "segment", "place", "turn", "role", "text", "initial", "fault", (F.col("place") > F.col("first")).alias("repeat")), "long-conversations")
    states = checkpoint(_composed(_segments(known)))
    parts = written(_parts(known, states), "repaired-parts")

    def run(batches):
        """Parts come in order; the hash is kept, the text is not."""
        own, digest, audit, values, tail = None, None, [], None, ""

        def row():
            final = digest.hexdigest()
            return pa.RecordBatch.from_arrays([pa.array([own[0]], pa_kind), *(pa.array([v], pa.int64()) for v in values), pa.array(["".join(audit)]), pa.array([final])], ["conv_id", *NAMES])

        pa_kind = None
        for batch in batches:
            pa_kind = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if own != (r["conv_id"],):
                    if own is not None:
                        yield row()
                    own, digest, audit, values, tail = (r["conv_id"],), hashlib.sha256(), [], [r[n] for n in NAMES[:6]], ""
                audit.append(r["audit"])
                if r["part"]:
                    digest.update((tail + r["part"][:-1]).encode())
                    tail = "\n"
        if own is not None:
            yield row()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(run, f"conv_id {kind}, {SCHEMA}")


def repair(conversations: DataFrame, partitions: int = 0) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = faults(conversations)
    real = F.col("copy") >= 0
    sizes = rows.groupBy("conv_id").agg(F.count_if(real).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    long = checkpoint(sizes.where((F.col("n") > LONG) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv_id").alias("_long")))
    if long.isEmpty():
        return repair_short(rows, partitions)
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    return repair_short(rows.join(long, same, "left_anti"), partitions).unionByName(repair_long(rows.join(long, same, "left_semi")))
