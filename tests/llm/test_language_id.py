import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from storyloom.llm import language_id


def brute_kernel(x, z):
    fold = language_id.fold_table()
    total = 0
    for n in (1, 2, 3):
        a, b = ({tuple(fold[ord(c)] for c in t[i : i + n]) for i in range(len(t) - n + 1)} for t in (x, z))
        total += len(a & b) / max(1, len(a) * len(b)) ** 0.5
    return total / 3


TEXTS = ["Der schnelle Fuchs", "", "été où ça, 123!", "a", "日本 x", "Fuchs schnell", "Ёж ёж"] * 20


def spectra(text):
    fold = language_id.fold_table()
    symbols = [int(fold[ord(c)]) for c in text]
    return [{tuple(symbols[i : i + n]) for i in range(len(symbols) - n + 1)} for n in (1, 2, 3)]


@pytest.mark.parametrize("places", [1 << 25, 0])
def test_presence_gives_the_kernel(monkeypatch, places):
    monkeypatch.setattr(language_id, "PLACES", places)
    each = [(g, i) for row, end, g in language_id.presence(pa.array([t.encode() for t in TEXTS], pa.large_binary())) for i in range(end - row)]
    assert len(each) == len(TEXTS)
    for (g, i), text in zip(each, TEXTS):
        assert set(g.of(i).tolist()) == {int(language_id.number([np.array([x]) for x in gram])[0]) for grams in spectra(text) for gram in grams}
        assert g.counts[i].tolist() == [len(s) for s in spectra(text)] and bool(g.letters[i]) == any(c.isalpha() for c in text)
    # The product with the scaled presence of another text is the kernel of the two.
    for z in TEXTS[:7]:
        codes = np.sort(np.concatenate([language_id.number([np.array([x[k] for x in sorted(s)], np.int64) for k in range(n + 1)]) if s else np.zeros(0, np.int64) for n, s in enumerate(spectra(z))]))
        if not len(codes):
            continue
        counts = np.array([len(s) for s in spectra(z)])
        column = (1 / np.sqrt(3 * counts[language_id.codes_length(codes)]))[:, None].astype(np.float32)
        for (g, i), x in list(zip(each, TEXTS))[:7]:
            assert abs(float(g.product(codes, column)[i, 0]) - brute_kernel(x, z)) < 1e-5


def test_the_matrix_is_kernel_ridge_regression():
    """Against a dense version: kernel by sets, Nystroem map, weighted ridge."""
    rng = random.Random(1)
    word = {"aa": "abcde", "bb": "cdefg", "cc": "жзик"}
    labels, texts = [], []
    for i in range(60):
        lang = sorted(word)[i % 3]
        labels.append(lang)
        texts.append(" ".join("".join(rng.choice(word[lang]) for _ in range(4)) for _ in range(rng.randint(1, 8))))
    of = lambda some: [g.of(i) for row, end, g in language_id.presence(pa.array([t.encode() for t in some], pa.large_binary())) for i in range(end - row)]
    languages, codes, matrix = language_id.solve(labels, of(texts), landmarks=20)
    kernel = lambda a, b: np.array([[brute_kernel(x, z) for z in b] for x in a])
    values, vectors = np.linalg.eigh(kernel(texts[:20], texts[:20]))
    good = values > 1e-6 * values[-1]
    project = vectors[:, good] / np.sqrt(values[good])
    phi = kernel(texts, texts[:20]) @ project
    y = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + language_id.RIDGE * np.eye(phi.shape[1]), phi.T @ y)
    fresh = ["abab cdcd", "зики", "efg", "q", texts[5]]
    got = next(language_id.presence(pa.array([t.encode() for t in fresh], pa.large_binary())))[2].product(codes, matrix)
    assert np.allclose(got, kernel(fresh, texts[:20]) @ project @ w, atol=1e-3)


def test_other_scripts_and_many_languages(spark):
    """Languages of letters of their own, and many of them."""
    rng = random.Random(2)
    rows = []
    for k in range(260):
        letters = [chr(0x4E00 + 13 * (6 * k + j)) for j in range(6)]
        rows += [(10 * k + i, " ".join("".join(rng.choice(letters) for _ in range(3)) for _ in range(6)), f"l{k:03d}") for i in range(8)]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {r[0]: r[2] for r in rows}
    learned = {truth[r.doc_id] for r in got if not r.held_out}
    held = [r for r in got if r.held_out and truth[r.doc_id] in learned]
    assert len(learned) > 250 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.predict(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_edges(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([(None, "en"), ("", "en"), ("123 !?", "de"), ("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("the house", None), ("und der Hund " * 30000, "de")] * 4)]
    docs = spark.createDataFrame(rows + rows[3:5] + [(None, "the cat", "en", 0)], "doc_id long, text string, lang string, score int")
    got = language_id.predict(docs).collect()
    assert len(got) == docs.count()
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is not None and (texts[r.doc_id] is None or not any(c.isalpha() for c in texts[r.doc_id])):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id is None:
            assert not r.held_out
        else:
            assert r.lang_pred in ("en", "de")


@pytest.mark.parametrize("rows", [[], [(1, "abc", None)]])
def test_nothing_to_learn(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.predict(docs).collect()] == ["und"] * len(rows)
