import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from storyloom.llm import codec, elias_fano, packing, token_files
from storyloom.llm.bpe import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [None, "", " ", "  ", "a  b", "don't 's 'sample ''s it's'", "\n's", "a\n\n b", "x <|endoftext|>  y <|endoftext|>", "<|endoftext|>", "日本語テキスト 漢字", "emoji 😀😃 👩‍👩‍👧", "\x1c\x1d a", "ſ's", "a" * 3000, "!?" * 500, "x" * 20000 + " y z" * 9000]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab 's \n\t1²é .!<|>endoftext日😀 trevlmd") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    rows = [(i, t, ["a", "b", None][i % 3] if i % 5 else "hot", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:8], "doc_id long, text string, source string, ids int").repartition(3).cache()


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_codec_matches_library(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = codec.digests(docs, PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = ids_of(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in codec.decode(codec.encode(docs, PATH), PATH).collect()}
    assert back == {k: v or "" for k, v in texts.items()}


def test_driver_table_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in codec.encode(docs, PATH).collect():
        assert r.ids == ids_of(texts[r.doc_id])


def test_incompatible_pairs_step_back():
    vocabulary = encoder(PATH).vocabulary
    rng = random.Random(0)
    for _ in range(3000):
        word = bytes(rng.choice(b"aeinorst") for _ in range(rng.randint(1, 24)))
        assert vocabulary.encode_word(word) == ids_of(word.decode())
        assert vocabulary.backtrack(word.decode(), []) == ids_of(word.decode())
        got, counts = vocabulary.encode_words(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
        assert got.tolist() == ids_of(word.decode()) and counts.tolist() == [len(got)]


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_that_hash_alike_stay_apart(size):
    """Polynomials modulo 2 ** 64 give the Thue-Morse word and its complement one hash."""
    ones = [bin(i).count("1") % 2 for i in range(size)]
    words = ["".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones), "".join("ab"[x] for x in ones)]
    raw = "".join(words).encode()
    bounds = np.arange(4) * size
    ids, at = encoder(PATH).encode(np.frombuffer(raw, np.uint8), bounds)
    for k, word in enumerate(words):
        assert ids[at[k] : at[k + 1]].tolist() == ids_of(word)
    assert encoder(PATH).vocabulary.decode(ids).tobytes() == raw


def test_lengths_around_the_switch():
    rng = random.Random(5)
    words = ["".join(rng.choice("aeinorst日1") for _ in range(n)) for n in range(30, 70) for _ in range(5)]
    raw = [w.encode() for w in words]
    ids, at = encoder(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(w) for w in words]


def test_merges_out_of_order_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "odd.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="order of training"):
        encoder(str(tmp_path / "odd.json"))


@pytest.mark.parametrize("gaps", [[0], [5, 0, 0, 7], [1] * 300, [0] * 200, [10**6, 3, 10**9]])
def test_elias_fano(gaps):
    values = np.cumsum(gaps)
    code = elias_fano.EliasFano(len(values), *elias_fano.encode(values))
    assert code.all().tolist() == values.tolist()
    assert [code.select(i) for i in range(len(values))] == values.tolist()
    assert all(code.select_many(a, b).tolist() == values[a:b].tolist() for a, b in [(0, 1), (63, 65), (64, 129), (100, 200), (7, 7)] if b <= len(values))


def test_token_files(spark, docs, tmp_path):
    token_files.write(docs, str(tmp_path / "ids"), PATH)
    got = token_files.documents(spark, str(tmp_path / "ids")).orderBy("start").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    start = 0
    for r in got:
        ids = [*ids_of(texts[r.doc_id]), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [tuple(r) for r in token_files.lookup(spark, str(tmp_path / "ids"), [3, 77, 10**6]).orderBy("doc_id").collect()] == [tuple(r) for r in got if r.doc_id in (3, 77)]
    assert {tuple(r) for r in token_files.offsets(spark, str(tmp_path / "ids")).collect()} == {(r.doc_id, r.start, r.n_tokens) for r in got}


def check_packing(docs, rows):
    texts = {r.doc_id: r.text for r in docs.collect()}
    parts = {}
    for r in rows:
        parts.setdefault(r.sequence_id, []).append(r)
        ids = [*ids_of(texts[r.doc_id]), 0]
        assert r.doc_tokens == len(ids)
        piece = ids[r.start : r.start + r.length]
        assert r.length == len(piece) > 0 and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        assert r.ids == piece
    last = max(parts)
    assert sorted(parts) == list(range(last + 1))
    for s, pieces in parts.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == packing.SEQUENCE or s == last and at <= packing.SEQUENCE
    total = sum(len(ids_of(r.text)) + 1 for r in docs.collect())
    assert sum(r.length for r in rows) == total


def test_packing_keeps_every_id(docs):
    check_packing(docs, packing.pack(docs, PATH, with_ids=True).collect())
    check_packing(docs, packing.pack(docs, PATH, targets={"hot": 0.5, "a": 0.1}, with_ids=True).collect())


def test_packing_holds_proportions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 400, "big" if i % 4 else "small") for i in range(800)], "doc_id long, text string, source string").repartition(5)
    monkeypatch.setattr(packing, "ROUND", 8 * packing.SEQUENCE)
    rows = packing.pack(docs, PATH).collect()
    windows, small = {}, {}
    for r in rows:
        w = r.sequence_id // 8
        windows[w] = windows.get(w, 0) + r.length
        small[w] = small.get(w, 0) + r.length * (r.doc_id % 4 == 0)
    for w in windows:
        assert abs(small[w] / windows[w] - 0.25) < 0.01


def test_tempered_windows_favour_small_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 400, "big" if i % 10 else "small") for i in range(1500)], "doc_id long, text string, source string").repartition(4)
    monkeypatch.setattr(packing, "ROUND", 8 * packing.SEQUENCE)
    share, small = 0.1**0.7 / (0.1**0.7 + 0.9**0.7), {}
    rows = packing.pack(docs, PATH, temper=0.7).collect()
    for r in rows:
        small[r.sequence_id // 8] = small.get(r.sequence_id // 8, 0) + r.length * (r.doc_id % 10 == 0)
    lasts = 0.1 / share * sum(r.length for r in rows) / (8 * packing.SEQUENCE)  # windows until the small source is dry
    for window, n in small.items():
        if window < int(lasts) - 1:
            assert abs(n / (8 * packing.SEQUENCE) - share) < 0.01
        elif window > int(lasts) + 1:
            assert n == 0


@pytest.mark.parametrize("totals,shares,over", [([5, 0, 3], [500, 0, 300], 8), ([1, 10**6, 77], [3, 1, 9], 1), ([10**13, 10**9], [10**13 * 65536, 10**9 * 65536], 10**13 + 10**9)])
def test_rounds_are_a_partition(totals, shares, over):
    rounds = packing.Rounds(totals, shares, over)
    if sum(totals) < 10**7:
        seen = sorted((place, n) for q, t in enumerate(totals) if t for _, n, place in rounds.pieces(q, 0, t, 1024))
        at = 0
        for place, n in seen:
            assert place == at
            at += n
        assert at == sum(totals)
    else:
        for q, t in enumerate(totals):
            assert sum(n for _, n, _ in rounds.pieces(q, t - 5000, 5000, 1024)) == 5000


def test_packing_gives_every_source_its_queue(spark, monkeypatch):
    """Targets hold for sources beyond those whose totals a task holds, and tables give the layout that tasks work out."""
    rows = [(i, "word " * (40 if i % 5 else 900), None if i % 5 == 4 else f"s{i % 5}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    monkeypatch.setattr(packing, "ROUND", 4 * packing.SEQUENCE)
    for targets, temper in ((None, 1.0), (None, 0.6), ({"s0": 0.5, "s3": 0.25, "s1": 0.25}, 1.0)):
        monkeypatch.setattr(packing, "QUEUES", 1000)
        want = packing.pack(docs, PATH, targets, with_ids=True, temper=temper).collect()
        monkeypatch.setattr(packing, "QUEUES", 2)
        got = packing.pack(docs, PATH, targets, with_ids=True, temper=temper).collect()
        check_packing(docs, got)
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    first = sum(r.length for r in got if r.doc_id % 5 == 0 and r.sequence_id < 4) / (4 * packing.SEQUENCE)
    assert abs(first - 0.5) < 0.01


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert codec.digests(docs, PATH).collect() == []
    assert packing.pack(docs, PATH).collect() == []
    token_files.write(docs, str(tmp_path / "none"), PATH)
    assert token_files.documents(spark, str(tmp_path / "none")).collect() == []
