import random
import re

import numpy as np
import pytest

from storyloom.llm import ngram_join
from storyloom.operators.graph import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            common = len(x & y)
            if common and 100 * common >= 80 * (len(x) + len(y) - common):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    bases = [prose(n) for n in (5, 6, 8, 9, 14, 40, 120, 400)]
    out = [None, "", " \t\n", "one", "One", "one two three four", "one  two\nthree four", "a b c d e", "A B C D E", "a b c d e f"]
    for _ in range(160):
        base = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            at = rng.randrange(len(base) + 1)
            kind = rng.random()
            if kind < 0.4:
                base[at:at] = prose(rng.randint(1, 8))
            elif kind < 0.7 and len(base) > 3:
                del base[at : at + rng.randint(1, 4)]
            elif at < len(base):
                base[at] = rng.choice(words)
        out.append((rng.choice([" ", "  ", "\n"])).join(base))
    out += [" ".join(prose(rng.randint(1, 60))) for _ in range(40)]
    return out


@pytest.mark.parametrize("seed,shard", [(1, 10**6), (2, 10**6), (3, 300)])
def test_matches_brute_force(spark, seed, shard):
    rows = list(enumerate(corpus(seed)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs, shard).collect()}
    assert got == brute(rows)


def test_frequent_ngrams_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "OFTEN", 2)
    rows = list(enumerate(corpus(4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs).collect()}
    assert got == brute(rows)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_confuse_stay_apart(spark):
    texts = []
    for n in (1024, 2048, 4096):
        word = thue_morse(n)
        other = word.translate(str.maketrans("ab", "ba"))
        texts += [word, other]
        texts += [f"one two three four five {w} six seven eight nine ten" for w in (word, other)]
    rows = list(enumerate(texts, 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and {c for _, c in got.values()} == set(got)


def test_sets_that_share_half_a_key_stay_apart(spark):
    rows = list(enumerate(corpus(8)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs, key_bits=3).collect()}
    assert got == brute(rows)


def test_texts_longer_than_a_piece(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(260_000)]
    near = words[:1000] + ["x"] + words[1001:]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:200_000])), (4, " ".join(words[:20_000])), (5, "a b c")]
    assert len(rows[0][1]) > 1 << 20
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_signatures_lose_no_pair():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.choice([4, 5, 6, 7, 10, 11, 15, 30, 31, 60, 200])
        base = [rng.getrandbits(64) for _ in range(n)]
        sets = [sorted(base)]
        for _ in range(12):
            s = list(base)
            for _ in range(rng.randint(0, max(1, n // 4))):
                if rng.random() < 0.5 and len(s) > 1:
                    s.pop(rng.randrange(len(s)))
                else:
                    s.append(rng.getrandbits(64))
            sets.append(sorted(set(s)))
        bounds = np.cumsum([0] + [len(s) for s in sets])
        row, sign = ngram_join.signatures(np.array([x for s in sets for x in s], np.uint64), bounds)
        signs = [set(sign[row == i].tolist()) for i in range(len(sets))]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                common = len(set(a) & set(b))
                if a != b and 100 * common >= 80 * (len(a) + len(b) - common):
                    assert signs[i] & signs[j]


def test_prefix_tree_finds_exactly_the_similar():
    rng = random.Random(6)
    base = rng.sample(range(500), 60)
    sets = []
    for _ in range(80):
        s = set(base)
        for _ in range(rng.randint(0, 12)):
            s.discard(rng.choice(base))
            s.add(rng.randrange(500))
        sets.append(sorted(s))
    sets = [np.array(s) for s in sorted(map(list, {tuple(s) for s in sets}))]
    tree = ngram_join.PrefixTree(sets)
    for i, s in enumerate(sets):
        member = np.zeros(500, bool)
        member[s] = True
        want = [j for j, t in enumerate(sets) if 100 * len(set(s) & set(t)) >= 80 * len(set(s) | set(t))]
        assert sorted(tree.similar(i, member)) == want
    for i in range(0, len(sets), 2):
        tree.remove(i)
    member = np.zeros(500, bool)
    member[sets[0]] = True
    assert all(j % 2 for j in tree.similar(0, member))


def test_components(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(-5, 500 + i) for i in range(30)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in want:
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_repeats_nulls_and_empty(spark):
    text = "w1 w2 w3 w4 w5 w6 w7 w8 w9"
    docs = spark.createDataFrame([(4, text), (4, text), (None, text), (9, text + " x"), (None, None), (7, "")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or -1) for r in ngram_join.groups(docs).collect())
    assert got == [(False, 4, 5, 4), (False, 4, 5, 4), (False, 7, 0, 7), (False, 9, 6, 4), (True, 0, 0, -1), (True, 0, 5, 4)]
    assert ngram_join.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sorted((r.doc_id or 0, r.text or "") for r in ngram_join.apply(docs).collect())[-1] == (7, "")


def test_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs).collect()} == brute(rows)
