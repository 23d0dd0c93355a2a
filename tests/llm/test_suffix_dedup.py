import numpy as np
import hashlib
import random

import pytest

from storyloom.llm import suffix_dedup


def brute(rows):
    """rows: (doc_id, text), sorted; result by doc_id."""
    seen, out = set(), {}
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(gone)))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, page = prose(40), prose(300)
    out = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "ab" * 400, "y" * 5000, passage, passage]
    for _ in range(60):
        kind = rng.random()
        if kind < 0.3:
            p = list(page)
            for _ in range(rng.randint(0, 6)):
                p[rng.randrange(len(p))] = rng.choice("abcé")
            out.append("".join(p))
        elif kind < 0.6:
            cut = rng.randrange(len(passage))
            out.append(prose(rng.randint(0, 50)) + passage[cut:] + prose(rng.randint(0, 50)) + passage[: rng.randrange(len(passage))])
        elif kind < 0.7:
            out.append(rng.choice(out))
        else:
            out.append(prose(rng.randint(1, 80)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = list(enumerate(texts(seed)))
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, kind int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_anchors_of_many_kinds_go_by_windows(spark, monkeypatch, seed):
    """A passage between different neighbours in most texts: every kind of its stretches differs."""
    monkeypatch.setattr(suffix_dedup, "KINDS", 64)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    licence, other = prose(22)[:130], prose(30)
    rows = [(i, f"{prose(rng.randint(4, 30))} {licence if i % 5 else other} {prose(rng.randint(4, 30))}") for i in range(400)]
    rows += [(400 + i, t) for i, t in enumerate(texts(seed))] + [(900, rows[3][1]), (901, rows[3][1] + licence)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = suffix_dedup.resolve(suffix_dedup.find(docs, 32), 32)
    assert len(suffix_dedup.hot_anchors(found)) > 0
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()}
    assert got == brute(sorted(rows))


def test_block_hashes_follow_the_bytes():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(0, 3, 500), np.zeros(200, np.int64)]).astype(np.uint8)
    for length in (1, 2, 3, 24, 64, 100, 700, 701):
        got = suffix_dedup.block_hashes(data, length, 5)
        blocks = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
        assert len(got) == len(blocks) and len(set(zip(got.tolist(), blocks))) == len(set(blocks)) == len(set(got.tolist()))


def test_a_text_longer_than_a_piece(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    rows = [(1, long), (2, "start " + long[500_000:500_400] + " end"), (3, long[:700_000])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    text = "Some text that is long enough to be found again by its windows. " * 3
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text + "tail")], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffix_dedup.dedup(docs).collect())
    want = brute([(5, text), (7, text + "tail"), (9, text)])
    assert got == [(False, 5, want[5][1]), (False, 5, want[5][1]), (False, 7, want[7][1]), (True, 0, want[9][1])]


def test_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, with_text=True).collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_longest_previous_factors():
    rng = np.random.default_rng(1)
    for n, width in ((1, 4), (2, 4), (40, 4), (300, 6)):
        suffixes = rng.integers(97, 99, (n, width)).astype(np.uint8)
        position = rng.permutation(n)
        want = [max([0, *(next((k for k in range(width) if a[k] != b[k]), width) for b, q in zip(suffixes, position) if q < p)]) for a, p in zip(suffixes, position)]
        assert suffix_dedup.longest_previous_factors(suffixes, position).tolist() == want


def test_previous_smaller():
    rng = np.random.default_rng(2)
    for values in ([3], [1, 2], [2, 1], [5, 4, 3, 2, 1], rng.permutation(200).tolist()):
        want = [max([-1, *(j for j in range(i) if values[j] < v)]) for i, v in enumerate(values)]
        assert suffix_dedup.previous_smaller(np.array(values)).tolist() == want
