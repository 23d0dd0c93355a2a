import hashlib
import heapq
import random
import re
import zlib

import pytest

from storyloom.llm import conversation_repair as cr

TIDY = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        chance = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if chance == 0:
            continue
        if chance == 1:
            text = ""
        if chance == 2:
            text = re.sub("[.!?]", "", text)
        if chance == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if chance == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))


def cheapest(rows, must, cut):
    """By Dijkstra over (row, roles so far as a state), letters least first; independent of the automaton's tables."""
    after = lambda state, c: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(c)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, made
        if (i, state) in done:
            continue
        done.add((i, state))
        for c, role in (("u", "user"), ("a", "assistant")):
            if after(state, c):
                heapq.heappush(heap, (cost + 3, audit + "I", i, after(state, c), made + (f"{role}:",)))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
            if not must[i]:
                more = 3 if cut[i] else 0
                if role and after(state, role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, after(state, role[0]), made + (f"{role}:{text}",)))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if after(state, c):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, after(state, c), made + (f"{name}:{text}",)))
    raise AssertionError


def brute(rows):
    found = {}
    by = {conv: [] for conv, *_ in rows}
    for row in damaged(rows):
        by[row[0]].append(row)
    for conv, some in by.items():
        seen, blank, repeat, cut = set(), [], [], []
        for _, _, role, text in some:
            real = re.sub(r"[\x20\x09-\x0D]+", "", text)
            blank.append(not real)
            repeat.append(bool(real) and (role, text) in seen)
            cut.append(bool(real) and not repeat[-1] and real[-1] not in ".!?")
            seen.add((role, text))
        turns = {t for _, t, _, _ in some if t is not None}
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        cost, audit, made = cheapest([r[2:] for r in some], [a or b for a, b in zip(blank, repeat)], cut)
        assert TIDY.fullmatch("".join(m[0] for m in made))
        found[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, sum(blank), sum(repeat), sum(cut), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return found


def answers(frame):
    return {r.conv_id: tuple(r[n] for n in cr.NAMES) for r in frame.collect()}


def corpus(seed, convs=150, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "assistant"])
            text = rng.choice(["Yes.", "No!", "hm", "", " \n\t", None, "a. b", "Why?\n", "é.", "x\x0b", " "])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Oh."), (900, 2, "user", "Twice."), (900, 2, "user", "Twice.")]
    dropped = next(i for i in range(10**6) if zlib.crc32(f"{i + 2000}:0".encode()) % 20 == 0) + 2000
    return rows + [(dropped, 0, "user", "gone.")]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,long,segment", [(1, 4096, 4096), (2, 5, 4)])
def test_matches_brute_force(spark, monkeypatch, seed, long, segment):
    monkeypatch.setattr(cr, "LONG", long)
    monkeypatch.setattr(cr, "SEGMENT", segment)
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", copy int, fault string").repartition(3)
    assert answers(cr.repair(table)) == brute(rows)


def test_a_conversation_of_many_segments(spark, monkeypatch):
    monkeypatch.setattr(cr, "LONG", 300)
    monkeypatch.setattr(cr, "SEGMENT", 64)
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No.", "so", ""]) + str(rng.randrange(400)) + rng.choice(".x")) for i in range(900)]
    rows += [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hi.")]
    assert answers(cr.repair(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_the_automaton_is_small_and_closed():
    table = cr.Table()
    assert table.close() == len(table.vectors) < 60
    assert all(min(v) == 0 and max(v) <= 14 for v in table.vectors)


def test_empty(spark):
    assert cr.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_driver_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert answers(cr.repair(table)) == brute(rows)
