import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from storyloom.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k=20):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    rows = []
    for item, text in queries:
        want, found = Counter(terms(text)), []
        for d, c in counts:
            if c:
                m = 100 - 25 + (25 * sum(c.values()) * n) // total
                score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in want.items() if t in c)
                if score > 0:
                    found.append((-score, d is None, d or 0, d))
        rows += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(rows)


def answers(docs, queries, k=20):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(docs, queries, k).collect())


def corpus(seed, n=700):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aBcdéÜ日9") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    weight = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: "".join(w + rng.choice([" ", "-", "\n", ". ", "\x00", "`"]) for w in rng.choices(words, weight, k=n))
    docs = [(i, text(rng.choice([1, 3, 10, 40, 200]))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(80)] + [(n + 90, None), (n + 91, ""), (n + 92, " .!\x7f"), (n + 93, docs[0][1]), (n + 93, docs[0][1])]
    queries = [(i, text(rng.choice([1, 2, 5, 30, 90]))) for i in range(25)]
    queries += [(100, None), (101, "..."), (102, "unheardof"), (103, docs[3][1] * 5), (None, docs[1][1])]
    return docs, queries


@pytest.mark.parametrize("seed,block,rows,lot", [(1, 4096, 1536, 4_000_000), (2, 64, 7, 400)])
def test_matches_brute_force(spark, monkeypatch, seed, block, rows, lot):
    for name, value in (("BLOCK", block), ("ROWS", rows), ("LOT_BYTES", lot)):
        monkeypatch.setattr(lexical_search, name, value)
    docs, queries = corpus(seed)
    queries = [(i or 0, t) for i, t in queries if i != 0]
    random.Random(seed).shuffle(docs)
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, query string, rank int").repartition(3)
    items = spark.createDataFrame([(i, t, 0) for i, t in queries], "item_id long, text string, doc_id int")
    assert answers(table, items) == brute(docs, queries)
    assert answers(table, items, 3) == brute(docs, queries, 3)


def test_small_lots_in_one_process(monkeypatch):
    monkeypatch.setattr(lexical_search, "ROWS", 7)
    docs, queries = corpus(3, 150)
    lot = lexical_search.Lot(queries[:25])
    vocabulary = lot.vocabulary.to_pylist()
    rng = np.random.default_rng(1)
    place, term = np.divmod(rng.choice(150 * len(vocabulary), 4000, replace=False), len(vocabulary))
    impact = rng.choice([1, 2, 3, 1000, 2**33 + 5], 4000)
    want = {}
    for q, t, times in zip(lot.query, lot.term, lot.times):
        for p, i in zip(place[term == t], impact[term == t]):
            want[(q, p)] = want.get((q, p), 0) + int(times) * int(i)
    got = {(q, p): s for names in lexical_search.Block(place, term, impact, 150).search(lot, 10**6) for q, p, s in zip(*(x.tolist() for x in names))}
    assert got == want


def test_edges(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (2, "a b"), (5, "c " * 700_000), (6, None)], schema)
    items = spark.createDataFrame([(1, "A"), (2, "c"), (3, None)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = answers(docs, items)
    assert got == brute(rows, [(1, "A"), (2, "c"), (3, None)])
    assert [d for i, _, d, _ in got if i == 1] == [2, 3, None]
    empty = spark.createDataFrame([], schema)
    assert answers(empty, items) == [] and answers(docs, items.limit(0)) == []


def test_driver_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert answers(docs, items) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
