"""Work that must not grow with the square of a table: copies, common names, wide rows."""

import datetime as dt
import glob
import re
import time
from collections import Counter
from itertools import combinations

from storyloom import checkpoints
from storyloom.operators import audits, dictionary, linking, semantic, surfaces, topics
from storyloom.plans import audit_queries, evidence_queries, story_queries, topic_queries
from tests.test_linking import Row, Rules, table


def test_copies_are_one_node_of_the_second_pass(spark, monkeypatch):
    """60 copies within four days, one of them far later, and one title near them: edges in proportion, groups as the rules say."""
    base = dt.datetime(2024, 1, 20)
    rows = [("Officials say Anna Kowal unveils Merrin tunnel", f"{'abc'[i % 3]}.x", "world", ["Merrin"], base + dt.timedelta(minutes=97 * i)) for i in range(60)]
    rows.append((*rows[0][:4], base + dt.timedelta(days=30)))
    rows.append(("Anna Kowal unveils Merrin tunnel at dawn", "d.x", "world", ["Merrin"], base + dt.timedelta(days=5)))
    rows += [(f"Filler{i} words{i} number{i}", "e.x", "world", [], base) for i in range(1700)]  # so that what copies share is rare
    start = linking.weighing(linking.features(table(spark, rows))).withColumn("grp", linking.F.col("ord"))
    seen = []
    found = linking.components
    monkeypatch.setattr(linking, "components", lambda edges: seen.append(edges.count()) or found(edges))
    got = {}
    for r in linking.second_pass(start).select("ord", "grp").collect():
        got.setdefault(r.grp, set()).add(r.ord)
    plain = [Row(i, *r) for i, r in enumerate(rows)]
    rules = Rules(plain)
    some = plain[:62]
    want = {frozenset(r.ord for r in g) for g in rules.merged([[r] for r in some])}
    assert {frozenset(g) for g in got.values() if min(g) < 62} == want and max(map(len, want)) == 61
    assert seen[0] <= 4 * len(some)  # 1,770 pairs of copies before


def _stories(spark):
    base = dt.datetime(2024, 1, 20)
    rows = [(i, "Merrin tunnel opens", ["Merrin", "Kowal"], base + dt.timedelta(minutes=i % 7), base + dt.timedelta(minutes=i % 7 + 1)) for i in range(60)]
    rows += [(100 + i, f"Merrin tunnel{i} shut{i} again{i % 3}", ["Merrin"] + ["Kowal"] * (i % 2), base + dt.timedelta(minutes=3 * i), base + dt.timedelta(minutes=4 * i)) for i in range(8)]
    rows.append((200, "Merrin", [], base, base))
    return spark.createDataFrame(rows, "grp long, title string, entities array<string>, first_at timestamp, last_at timestamp")


def _passing(stories):
    """(a, b, shared, similarity) of all ordered pairs that pass, from words by the same function."""
    words = {r.grp: set(r.words) for r in stories.select("grp", surfaces.text.title_tokens("title").alias("words")).collect()}
    rows = {r.grp: r for r in stories.collect()}
    for a, b in combinations(rows, 2):
        shared = len(set(rows[a].entities) & set(rows[b].entities))
        alike = len(words[a] & words[b]) / len(words[a] | words[b]) if words[a] and words[b] else 0
        if shared >= 2 or shared == 1 and alike >= 0.2:
            yield from ((rows[a], rows[b], shared, alike), (rows[b], rows[a], shared, alike))


def _ranked(monkeypatch):
    seen = []
    found = surfaces.top_of_each
    monkeypatch.setattr(surfaces, "top_of_each", lambda rows, *more: seen.append(rows.count()) or found(rows, *more))
    return seen


def test_related_looks_at_copies_once(spark, monkeypatch):
    stories = _stories(spark).cache()
    want = {}
    for a, b, shared, alike in _passing(stories):
        want.setdefault(a.grp, []).append((-(shared + alike), b.grp))
    for common in (200, 2):
        with monkeypatch.context() as patched:
            seen = _ranked(patched)
            got = {}
            for r in surfaces.related(stories, common=common).collect():
                got.setdefault(r.grp, set()).add((-r.score, r.other))
        assert got == {a: set(sorted(of)[:4]) for a, of in want.items()}
        assert max(seen) <= 68 * 5  # 3,540 pairs of copies before


def test_earlier_looks_at_copies_once(spark, monkeypatch):
    stories = _stories(spark).cache()
    want = {}
    for a, b, shared, _ in _passing(stories):
        if b.last_at < a.first_at:
            want.setdefault(a.grp, []).append((-b.last_at.timestamp(), b.grp, shared))
    seen = _ranked(monkeypatch)
    got = {}
    for r in surfaces.earlier(stories, stories).collect():
        got.setdefault(r.grp, set()).add((-r.ended.timestamp(), r.other, r.shared))
    assert got == {a: set(sorted(of)[:5]) for a, of in want.items()}
    assert max(seen) <= 69 * 6


def test_members_without_support_meet_only_what_may_support_them(spark, monkeypatch):
    """A group of 40 titles of which two support each other: pairs in proportion, the same members stay."""
    base = dt.datetime(2024, 1, 20)
    rows = [(f"Merrin{i} tunnel{i} shut{i} again{i}", f"d{i}.x", "world", [], base + dt.timedelta(minutes=i)) for i in range(38)]
    rows += [("Anna Kowal unveils ferry", f"e{i}.x", "world", [], base + dt.timedelta(minutes=40 + i)) for i in range(2)]
    start = linking.weighing(linking.features(table(spark, rows))).withColumn("grp", linking.F.lit(39).cast("long"))
    seen = []
    decide = linking.decide
    monkeypatch.setattr(linking, "decide", lambda pairs, rows: seen.append(pairs.count()) or decide(pairs, rows))
    got = {r.ord: r.grp for r in linking.validated(start).select("ord", "grp").collect()}
    assert len(got) == 40
    plain = [Row(i, *r) for i, r in enumerate(rows)]
    assert {frozenset(o for o in got if got[o] == g) for g in set(got.values())} == {frozenset(r.ord for r in g) for g in Rules(plain).validated([plain])}
    assert max(seen) <= 2 * len(rows)  # 39 times 40 before


def test_near_misses_of_a_known_score_meet_by_needed_stems(spark, monkeypatch):
    """The bound on the score leaves the best pairs as they are and keeps most pairs apart."""
    base = dt.datetime(2024, 1, 20)
    long = lambda i: " ".join(f"stem{i // 2}x{j}" for j in range(30 + i))
    rows = [(f"{long(i)} end{i}", f"d{i}.x", "world", [], base + dt.timedelta(minutes=i)) for i in range(12)]
    rows += [(f"Merrin tunnel shut{i}", f"e{i}.x", "world", [], base + dt.timedelta(minutes=i)) for i in range(40)]
    leads = linking.weighing(linking.features(table(spark, rows))).withColumn("single", linking.F.lit(True)).cache()
    generic = leads.select(linking.F.explode("names").alias("name")).limit(0)
    seen = []
    rated = audits._rated
    monkeypatch.setattr(audits, "_rated", lambda pairs, *more: seen.append(pairs.count()) or rated(pairs, *more))
    every = [tuple(r) for r in audits.near_misses(leads, generic, cap=1000).collect()]
    whole, seen[:] = seen[-1], []
    assert [tuple(r) for r in audits.near_misses(leads, generic, cap=5).collect()] == every[:5]
    assert seen[-1] <= 12 * 2 < whole


def test_topics_are_keyed_by_name_not_by_mention(spark, monkeypatch):
    """Keys are worked out for as many rows as there are names and slugs."""
    names = topic_queries.mentions(spark, "/root/testdata/sf0.001").select("name").distinct().count()
    seen, keyed = [], topics.with_keys
    monkeypatch.setattr(topics, "with_keys", lambda rows, *more: seen.append(rows.count()) or keyed(rows, *more))
    for query in (topic_queries.topic_directory, topic_queries.topic_resolution, topic_queries.topic_stories):
        query(spark, "/root/testdata/sf0.001").count()
    assert max(seen) <= 1.5 * names  # every mention before


def test_lines_of_archive_rows_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks that gather lines to lists grow in number with the table, whatever the session's partitions."""
    monkeypatch.setattr(audit_queries, "LINES", 500, raising=False)
    rows = audit_queries.archived(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= 10  # 4 partitions of the session, or fewer, before


def test_products_of_vectors_are_bounded_by_cells(monkeypatch):
    """A chunk of the base meets so many queries at a time that their cosines stay below the bound."""
    rng = semantic.np.random.default_rng(1)
    frame = semantic.pd.DataFrame({"vec_id": range(4000), "embedding": list(rng.normal(size=(4000, 4)))})
    seen, choose = [], semantic.np.argpartition
    monkeypatch.setattr(semantic.np, "argpartition", lambda s, *a, **k: seen.append(s.size) or choose(s, *a, **k))
    got = semantic._best(frame.iloc[:1000], frame, 3)
    assert len(got) == 3000 and max(seen) <= 1 << 20  # 4,000,000 before


def test_words_of_texts_are_split_once(spark):
    """The plan splits a text once for its places, and a row has the words that a term may have, not those of its text."""
    texts = spark.createDataFrame([(1, "The white house, white  house. White houses")], "ord int, t string")
    terms = spark.createDataFrame([("white house",), ("house",)], "term string")
    found = dictionary.matches(texts, terms, ["ord"], "t")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "regexp_replace" not in plan  # two patterns and a split, three times, before
    assert sorted((r.term, r["at"], r["size"], r.form) for r in found.collect()) == [("house", 2, 1, "house"), ("house", 6, 1, "house"), ("house", 9, 1, "houses"), ("white house", 1, 2, "white house"), ("white house", 8, 2, "white houses")]


def test_pairs_of_rare_words_are_not_counted(spark, monkeypatch):
    """The most frequent pairs are those of all words, however few words the count begins with."""
    texts = ["a b c d", "a b d c", "b a x y", "x y a b", "x y", "q x y", "c a"] + [f"w{i} v{i} a" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, low string").cache()
    words, pairs = Counter(), Counter()
    for t in texts:
        words.update(set(t.split()))
        pairs.update(set(re.findall("[a-z0-9]+ [a-z0-9]+", t)))
    counts = spark.createDataFrame(list(words.items()), "term string, _n long")
    want = sorted(pairs.items(), key=lambda p: (-p[1], p[0]))
    for most in (2, 3, 60):
        for paired in (1, 4, 8, 1024):
            assert sorted(map(tuple, evidence_queries.frequent_pairs(docs, counts, most, paired).collect()), key=lambda p: (-p[1], p[0])) == want[:most]
    seen = []
    cut = evidence_queries.checkpoint
    monkeypatch.setattr(evidence_queries, "checkpoint", lambda frame: seen.append(frame) or cut(frame))
    evidence_queries.frequent_pairs(docs, counts, 2, 5)
    assert len(seen) == 2  # one look at the pairs of five words is enough


def _shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {path for folder in folders for path in glob.glob(f"{folder}/*/shuffle_*.data")}


def test_steps_leave_no_shuffle_files(spark):
    """Files of a step's shuffles go with the step, not when the driver happens to collect its garbage; what it was made of can be used again."""
    frame = spark.range(1000).groupBy((linking.F.col("id") % 10).alias("k")).agg(linking.F.count(linking.F.lit(1)).alias("n"))
    setting = spark.conf.get(checkpoints.CLEANUP)
    for step in (checkpoints.checkpoint, checkpoints.stored):
        before = _shuffle_files(spark)
        kept = step(frame)
        for _ in range(50):  # Spark removes them in the background
            if not (left := _shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        assert not left  # a file for each task before
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, frame.collect())) == sorted(map(tuple, frame.collect())) == [(k, 100) for k in range(10)]
        assert kept.columns == frame.columns and spark.conf.get(checkpoints.CLEANUP) == setting


def test_wide_steps_of_linking_are_tables(spark, monkeypatch):
    """What carries the features of all titles is a Parquet table, of which a reader takes the columns that it needs."""
    seen = []
    cut = linking.checkpoint
    monkeypatch.setattr(linking, "checkpoint", lambda frame: seen.append(frame.columns) or cut(frame))
    base = dt.datetime(2024, 1, 20)
    rows = [("Officials say Anna Kowal unveils Merrin tunnel", f"{'abc'[i % 3]}.x", "world", ["Merrin"], base + dt.timedelta(minutes=97 * i)) for i in range(6)]
    assert linking.cluster(table(spark, rows)).count() == 6
    assert seen and not [columns for columns in seen if {"bigrams", "tops"} & set(columns)]  # features, prints and groups before


def test_decisions_carry_no_texts_and_compare_no_structs(spark, monkeypatch):
    """Terms that two titles share are found by hashes of strings, each set once; no step of pair_decisions has the texts."""
    seen = []
    decide = linking.decide
    monkeypatch.setattr(linking, "decide", lambda pairs, rows: seen.append(rows.columns) or decide(pairs, rows))
    out = story_queries.pair_decisions(spark, "/root/testdata/sf0.001")
    plan = re.sub(r"#\d+L?", "", out._jdf.queryExecution().optimizedPlan().toString())
    assert not {"text", "description"} & set(seen[0])  # both before
    assert "array_intersect(_a.prints, _b.prints)" not in plan and plan.count("array_intersect(_a.tokens, _b.tokens)") == 1
    assert out.count() > 0


def test_members_that_too_few_can_support_meet_nobody(spark, monkeypatch):
    """A group of 60 titles, of which each shares a stem with a fifth of the others: nobody can be kept by them, so no pairs are looked at."""
    base = dt.datetime(2024, 1, 20)
    rows = [(f"Merrin{i % 5} tunnel{i} shut{i} again{i}", f"d{i}.x", "world", [], base + dt.timedelta(minutes=i)) for i in range(60)]
    rows += [(f"Filler{i} words{i} number{i}", "e.x", "world", [], base) for i in range(300)]  # so that what a fifth shares is rare
    start = linking.weighing(linking.features(table(spark, rows))).withColumn("grp", linking.F.when(linking.F.col("ord") < 60, 59).otherwise(linking.F.col("ord")).cast("long"))
    seen = []
    decide = linking.decide
    monkeypatch.setattr(linking, "decide", lambda pairs, rows: seen.append(pairs.count()) or decide(pairs, rows))
    got = {r.ord: r.grp for r in linking.validated(start).select("ord", "grp").collect()}
    plain = [Row(i, *r) for i, r in enumerate(rows)]
    assert {frozenset(o for o in got if o < 60 and got[o] == g) for o2, g in got.items() if o2 < 60} == {frozenset(r.ord for r in g) for g in Rules(plain).validated([plain[:60]])}
    assert len(seen) == 2 and seen[1] == 0  # 59 times 12 before
