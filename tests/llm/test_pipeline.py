import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storyloom.llm import exact_dedup, line_dedup, ngram_join, packing, quality, secrets
from storyloom.llm.tokenizers import byte_bpe
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_secrets import brute as base_secrets
from tests.llm.test_tokens import check_packing

DIR = "/root/testdata/sf0.001"


def one_by_one(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DIR).cache()
        yield before, docs


def drop_lines(rows):
    """rows: (doc_id, source, text)."""
    key = lambda line: " ".join(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)
    sites = {}
    for _, source, text in rows:
        for line in text.split("\n"):
            sites.setdefault(key(line), set()).add(source)
    seen, out = set(), {}
    for doc, _, text in sorted(rows):
        left, several = [], sum(bool(key(line)) for line in text.split("\n")) > 1
        for line in text.split("\n"):
            k = key(line)
            if k and len(sites[k]) >= line_dedup.MIN_SITES:
                if k in seen and several:
                    continue
                seen.add(k)
            left.append(line)
        if len(left) == text.count("\n") + 1 or any(key(x) for x in left):
            out[doc] = "\n".join(left)
    return out


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    steps = list(one_by_one(spark, docs))
    for before, after in steps[:-1]:
        assert after.columns == before.columns
    kept = {r.doc_id for r in steps[0][1].collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    assert kept == {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.sql()}) WHERE kept").fetchall()}
    before, after = steps[1]
    want = drop_lines([(r.doc_id, r.source, r.text) for r in before.collect()])
    assert {r.doc_id: r.text for r in after.collect()} == want
    before, after = steps[2]
    found = groups([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {d for d, (_, c) in found.items() if c == d}
    before, after = steps[3]
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert (r.text == old[r.doc_id]) == (not base_secrets(old[r.doc_id])) and r.n_chars == len(r.text)
        assert not base_secrets(r.text)
    check_packing(*[steps[4][0], steps[4][1].collect()])


def test_run_gives_the_same_pieces(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    *_, last = one_by_one(spark, spark.read.parquet(f"{DIR}/documents.parquet"))
    assert sorted((r.doc_id, r.start, r.length) for r in rows) != [] and sum(r.length for r in rows) == sum(r.length for r in last[1].collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c " * 9, None, "s", 54), (2, "a b c " * 9, None, "s", 54)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for before, after in one_by_one(spark, docs):
        assert after.count() <= max(before.count(), 4)


def test_quality_and_lines_and_copies_handle_odd_rows(spark):
    long = "word%d " * 5
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", 1, "k") for i, t in enumerate([None, "", " ", "a b", (long % (1, 2, 3, 4, 5)) * 4000, "same line here now\n" * 12, "x" * 50000])]
    docs = spark.createDataFrame(rows + rows[3:6] + [(None, "some words in a row", None, None, None, None)], "doc_id long, text string, lang string, source string, kept int, digest string")
    judged = {(r.doc_id, r.n_words): r for r in quality.judge(docs).collect()}
    assert judged[0, 0].base_failed and not judged[0, 0].kept
    assert judged[4, 20000].n_repeat_words == 20000 and judged[5, 48].n_dup_lines == 11
    assert set(quality.apply(docs).columns) == set(docs.columns)
    report = line_dedup.report(docs, min_sites=2).collect()
    assert len(report) == docs.count() and {r.doc_id: r.n_lines for r in report}[0] == 0
    copies = exact_dedup.assign(docs).collect()
    assert len(copies) == docs.count() and sum(r.kept for r in copies) == 6
    assert {r.group_size for r in copies if r.doc_id in (0, 1, 2)} == {3}
    assert exact_dedup.deduplicate(docs).columns == docs.columns


def test_menu_lines_repeats_and_lone_lines(spark):
    """Short lines count, a document of one line keeps it, and repeated rows are treated alike, as in the SQL."""
    menu = [(i, f"Home\nown words of page {i}\nNext page", f"site{i % 5}") for i in range(20)]
    alone = [(100 + i, "\nHome \n", f"site{i}") for i in range(5)]
    rows = menu + menu[:7] + alone + [(None, "Home\nof a page without a name", None), (3, "Home\nanother text of page 3", "site9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.report(docs, min_sites=3)
    assert {r.doc_id: r.n_removed for r in got.collect() if r.doc_id != 3} == {None: 1} | {i: 2 * (i > 0) for i in range(20) if i != 3} | {100 + i: 0 for i in range(5)}
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    sql = line_dedup.SQL.replace(f">= {line_dedup.MIN_SITES}", ">= 3")
    want = con.execute(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({sql})").fetchall()
    by = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got.collect()), key=by) == sorted(want, key=by)


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "_in", "k", "x y", "pos", "c0"]
    rows = [(i, f"some words that stand here in row {i} and nowhere else at all", "en", "s", 1, i, 2, 3, 4, 5, 6) for i in range(4)]
    docs = spark.createDataFrame(rows, names)
    for stage in (quality.apply, line_dedup.apply, ngram_join.apply, secrets.redact):
        after = stage(docs)
        assert after.columns == names and sorted(map(tuple, after.collect())) == rows
    assert exact_dedup.deduplicate(docs).columns == names and packing.pack(docs, byte_bpe()).count() == 4


def test_bins_are_close_and_merge(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 12345, 10**12]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality._bin(F.col("v")).alias("b")).collect()
    assert all(r.b <= r.v < r.b * 33 / 32 or r.b == r.v for r in rows)


def test_quality_fences_follow_the_corpus(spark):
    """In a corpus free of symbols and repeats, a document with clearly more of them than the rest goes, below any wide floor."""
    words = lambda i, n, start=0: " ".join(f"w{i:03d}{j:03d}" for j in range(start, start + n))
    lines = lambda i, same: "\n".join(["one line that stands here"] * (same + 1) + [words(i, 9, 9 * k) for k in range(20 - same)])
    clean = [(i, lines(i, 0)) for i in range(200)]
    odd = [(1000, lines(500, 4)), (1001, words(501, 300) + " #" * 60), (1002, words(502, 250) + " " + " ".join([words(503, 20)] * 2))]
    few = [(2000, words(504, 30) + " # *"), (2001, lines(505, 1))]
    rows = [(i, text, "en", "s") for i, text in clean + odd + few]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert not any(judged[i].base_failed or judged[i].kept for i in (1000, 1001, 1002))
    assert all(judged[i].kept for i, _ in clean + few)
