import datetime as dt

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import archive, graph, ingest, linking, ordering, reports, semantic, stories, surfaces, topics
from storyloom.streaming import flows

def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_normalise_drops_bad_rows(spark):
    rows = [
        (1, "A proper headline here", "https://www.example.com/a?utm_source=x", "Name", "<p>Text</p>", "2024-01-30T10:00:00Z"),
        (2, "short", "https://example.com/b", "Name", "t", "2024-01-30T10:00:00Z"),
        (3, "[removed]", "https://example.com/c", "Name", "t", "2024-01-30T10:00:00Z"),
        (4, "Another proper headline", "mailto:x@y", "Name", "t", "2024-01-30T10:00:00Z"),
        (5, "Headline from the future", "https://example.com/d", "Name", "t", "2024-01-31T00:31:00Z"),
        (6, "Headline without a date", "https://example.com/e", "Name", "t", "yesterday"),
        (7, "Copy of the first headline", "http://example.com/a", "Name", None, "2024-01-30T11:00:00Z"),
    ]
    raw = spark.createDataFrame(rows, "ord int, title string, url string, source string, description string, published_at string")
    sources = spark.createDataFrame([("example.com", "Name", "A")], "domain string, name string, tier string")
    out = ingest.normalise(raw, now(), sources).orderBy("ord").collect()
    assert [r.ord for r in out] == [1, 7] and out[0].id == out[1].id and out[0].tier == "A" and out[0].slug.endswith(out[0].id)
    assert [r.ord for r in ingest.dedupe(ingest.normalise(raw, now())).collect()] == [1]


def articles(spark, rows):
    schema = "ord long, title string, domain string, source string, tier string, category string, country string, content_type string, description string, canonical_url string, id string, entities array<string>, published_at timestamp"
    full = [(i, t, d, d, "B", c, "US", "news", "text", f"https://{d}/{i}", str(i), e, ts(at)) for i, (t, d, c, e, at) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


EVENT = [
    ("Storm floods coastal towns in Maine", "a.x", "climate", ["Maine"], "2024-01-30 10:00:00"),
    ("Coastal towns in Maine flooded by storm", "b.x", "climate", ["Maine"], "2024-01-30 11:00:00"),
    ("Maine storm floods coastal towns overnight", "c.x", "climate", ["Maine"], "2024-01-30 12:00:00"),
    ("Storm floods coastal towns in Maine", "a.x", "climate", ["Maine"], "2024-01-30 10:30:00"),
    ("Storm floods coastal towns in Maine", "d.x", "climate", ["Maine"], "2024-01-20 10:00:00"),
    ("Chip maker unveils faster processor", "a.x", "technology", ["Acme"], "2024-01-30 10:00:00"),
    ("Bank merger wins approval", "b.x", "business", [], "2024-01-30 10:00:00"),
]


def test_clusters_by_event(spark):
    rows = linking.cluster(articles(spark, EVENT))
    groups = {r.ord: r.grp for r in rows.select("ord", "grp").collect()}
    assert groups[0] == groups[1] == groups[2]
    assert len({groups[i] for i in (0, 4, 5, 6)}) == 4  # too old, other events
    built = stories.ranked(stories.build(rows, now()), now()).orderBy("rank").collect()
    assert built[0].n_articles >= 3 and built[0].rank == 1 and [r.rank for r in built] == list(range(1, len(built) + 1))
    assert all(a.score >= b.score for a, b in zip(built, built[1:]))


def test_pair_blocking_respects_the_cutoff(spark):
    rows = articles(spark, [(f"common word{i}", f"{i}.x", "world", [], "2024-01-30 10:00:00") for i in range(60)])
    assert linking.candidates(linking.features(rows)).count() == 0


def test_ids_are_inherited_one_to_one(spark):
    groups = spark.createDataFrame([(1, "u1"), (1, "u2"), (2, "u3"), (2, "u1b"), (3, "u9")], "grp int, url string")
    old = spark.createDataFrame([("cA", "u1"), ("cA", "u2"), ("cA", "u3"), ("cB", "u3")], "cluster_id string, url string")
    assert {(r.grp, r.cluster_id) for r in linking.inherit_ids(groups, old).collect()} == {(1, "cA"), (2, "cB")}


def test_components_and_pointers(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "a long, b long")
    assert {(r.node, r.label) for r in graph.components(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    hops = spark.createDataFrame([(5, 4), (4, 3), (9, 3)], "node long, target long")
    assert {(r.node, r.target) for r in graph.flatten_pointers(hops).collect()} == {(5, 3), (4, 3), (9, 3)}


def test_upsert_keeps_first_seen(spark):
    old = spark.createDataFrame([(1, "a", ts("2024-01-01"), ts("2024-01-02")), (2, "b", ts("2024-01-01"), ts("2024-01-02"))], "key int, title string, first_seen timestamp, last_modified timestamp")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "key int, title string")
    out = {r.key: r for r in archive.upsert(old, new, "key", ["title"], now()).collect()}
    assert [out[k].action for k in (1, 2, 3)] == ["keep", "update", "insert"] and out[2].first_seen == ts("2024-01-01") and out[1].title == "a"


def test_churn_is_cancelled(spark):
    events = [("coverage_change", ts("2024-01-01 00:00:00"), "1", "2"), ("coverage_change", ts("2024-01-01 05:00:00"), "2", "1"), ("category_changed", ts("2024-01-01 06:00:00"), "a", "b"), ("headline_updated", ts("2024-01-02 00:00:00"), "x", "y"), ("coverage_change", ts("2024-01-03 00:00:00"), "1", "3"), ("coverage_change", ts("2024-01-05 00:00:00"), "3", "1")]
    rows = spark.createDataFrame([(events,)], "h array<struct<kind string, at timestamp, old string, new string>>")
    assert [e.kind for e in rows.select(archive.without_churn("h").alias("k")).first().k] == ["headline_updated", "coverage_change", "coverage_change"]


@pytest.mark.parametrize("previous,candidate,streak_of,streak,moved,want", [("a", "a", None, 0, 0, "a"), ("a", "b", None, 0, 0, "a"), ("a", "b", "b", 1, 0, "b"), ("a", "b", None, 0, 2, "b"), (None, "b", None, 0, 0, "b")])
def test_hysteresis(spark, previous, candidate, streak_of, streak, moved, want):
    row = spark.createDataFrame([(previous, candidate, streak_of, streak, moved)], "p string, c string, o string, s int, m int")
    assert row.select(archive.hysteresis(*(F.col(c) for c in "pcosm")).alias("h")).first().h.category == want


def test_pages_and_ranks(spark):
    rows = spark.range(95).withColumn("v", F.col("id") % 10)
    placed = {r.id: r.place for r in ordering.with_place(rows, [F.desc("v"), F.asc("id")]).collect()}
    want = sorted(range(95), key=lambda i: (-(i % 10), i))
    assert [placed[i] for i in want] == list(range(1, 96))
    assert [r.id for r in ordering.page(rows, [F.asc("id")], 99, 10).collect()] == list(range(90, 95))


def test_exclusive_slots(spark):
    rows = spark.createDataFrame([(i, i, "US" if i % 2 else "CA") for i in range(1, 21)], "rank int, grp int, country string")
    got = surfaces.exclusive(rows, [("hero", F.lit(True), 1), ("us", F.col("country") == "US", 3), ("all", F.lit(True), 5)]).collect()
    assert sorted((r.slot, r.rank) for r in got) == [("all", 2), ("all", 4), ("all", 6), ("all", 8), ("all", 9), ("hero", 1), ("us", 3), ("us", 5), ("us", 7)]


def test_search_parsing_and_resolution(spark):
    assert surfaces.parse({"country": "mars", "page": "-2", "sort": "newest"}) == {"country": "all", "category": "all", "time": "all", "sort": "newest", "page": 1}
    live = spark.createDataFrame([("c0123456789ab", "new-title-c0123456789ab")], "cluster_id string, slug string")
    moved = spark.createDataFrame([("caaaaaaaaaaaa", "c0123456789ab")], "node string, target string")
    asked = spark.createDataFrame([("new-title-c0123456789ab",), ("old-title-c0123456789ab",), ("x-caaaaaaaaaaaa",), ("y-cbbbbbbbbbbbb",), ("nothing",)], "slug string")
    out = {r.slug: r.outcome for r in surfaces.resolve(asked, live, live.limit(0), moved).collect()}
    assert list(map(out.get, [r.slug for r in asked.collect()])) == ["live", "redirect", "merged", "unavailable", "not-found"]


def test_trending_and_topics(spark):
    rows = spark.createDataFrame([(1, 50.0, 2, ["Ontario Province", "Acme"]), (2, 40.0, 1, ["Ontario"]), (3, 10.0, 1, ["Solo"])], "grp int, score double, n_articles long, entities array<string>")
    assert [r.key for r in topics.trending(rows).collect()] == ["ontario"]
    index = {r.key: r for r in topics.index(rows).collect()}
    assert index["ontario"].display == "Ontario Province" and index["ontario"].n_stories == 2 and index["ontario"].eligible and not index["solo"].eligible


def test_buckets_and_recall(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (7,), (None,)], "n int")
    assert [sorted(r[0]) for r in rows.select(reports.bucket_keys(F.col("n"))).collect()] == [["1"], ["2", "2+"], ["2+", "3", "3+"], ["2+", "3+", "4+"], ["unknown"]]
    pairs = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "t boolean, f boolean")
    assert tuple(reports.precision_recall(pairs, "t", "f").first()) == (1, 1, 1, 0.5, 0.5)


def test_gates(spark):
    row = spark.createDataFrame([("general", "world", 0.9), ("general", "world", 0.8), ("sports", "world", 0.99)], "c string, p string, s double")
    assert [r[0] for r in row.select(semantic.override(F.col("c"), F.col("p"), F.col("s"))).collect()] == ["world", "general", "sports"]


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    query = flows.publish(stream, out, str(tmp_path / "check"))
    query.awaitTermination()
    assert spark.read.parquet(out).count() == rows.count()
    assert flows.latest(spark, out).select("generation").distinct().count() == 1
    late = flows.finished(flows.tumbling(stream), "tumbling_test", "complete")
    assert late.agg(F.sum("n")).first()[0] == rows.count()
    assert flows.due(None) and flows.due(26) and not flows.due(10) and flows.due(10, new_day=True)


def test_alike_titles_link_in_groups_of_any_size(spark):
    import random

    pick = random.Random(5)
    sets = [["budget", "vote"]] * 130 + [[], []] + [sorted(pick.sample("abcdefgh", pick.randint(1, 7))) for _ in range(90)]
    sets += [[f"w{i}" for i in range(10) if i != k] for k in range(10)] + [[f"w{i}" for i in range(10)]]
    rows = spark.createDataFrame(list(enumerate(sets)), "ord long, tokens array<string>")
    found = {r.ord: r.grp for r in linking.grouped(rows, linking.alike(rows)).collect()}
    want = list(range(len(sets)))
    for _ in sets:
        before = list(want)
        for i, x in enumerate(sets):
            for j in range(i):
                if x and sets[j] and 5 * len(set(x) & set(sets[j])) >= 4 * len(set(x) | set(sets[j])):
                    want[i] = want[j] = min(want[i], want[j])
        if want == before:
            break
    assert found == dict(enumerate(want))


def test_nearest_against_brute_force(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    vectors = draw.integers(-2, 3, (90, 3)).astype(float)
    vectors[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(90, None)], "vec_id long, embedding array<double>")
    found = semantic.nearest(rows.where("vec_id % 3 = 0"), rows, 5, block=16).collect()
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norms == 0, 1, norms)[:, None]
    cosine = (unit @ unit.T).round(9)
    for q in range(0, 90, 3):
        got = sorted((r.cosine for r in found if r.query == q), reverse=True)
        assert np.allclose(got, sorted((cosine[q, j] for j in range(90) if j != q), reverse=True)[:5])
    assert all(r.query != r.vec_id and abs(r.cosine - cosine[r.query, r.vec_id]) < 1e-9 for r in found)
    assert semantic.nearest(rows.where("vec_id < 0"), rows, 5).count() == 0


def test_related_finds_pairs_of_common_names(spark):
    import random

    pick = random.Random(9)
    words = "budget storm rescue museum island harbour railway".split()
    rows = []
    for i in range(70):
        names = sorted({pick.choice(["Alpha", "Beta", "Gamma"]) for _ in range(2)} | ({f"Rare{i % 9}"} if i % 4 == 0 else set()))
        rows.append((i, " ".join(pick.sample(words, pick.randint(0, 6))), names if i else []))
    stories_ = spark.createDataFrame(rows, "grp long, title string, entities array<string>")
    stems = {r.grp: set(r.w) for r in stories_.select("grp", text.title_tokens("title").alias("w")).collect()}
    want = {}
    for i, _, x in rows:
        passed = []
        for j, _, y in rows:
            n, either = len(set(x) & set(y)), stems[i] | stems[j]
            alike = len(stems[i] & stems[j]) / len(either) if stems[i] and stems[j] else 0.0
            if i != j and (n >= 2 or n == 1 and alike >= 0.2):
                passed.append((-(n + alike), j))
        want[i] = [j for _, j in sorted(passed)[:4]]
    for common in (2, 200):
        found = surfaces.related(stories_, common=common).collect()
        assert {i: [r.other for r in sorted((r for r in found if r.grp == i), key=lambda r: (-r.score, r.other))] for i in want} == want


def test_earlier_and_related_take_common_names(spark):
    """Every limit on common names gives the pairs of comparing all with all."""
    titles = ["Storm floods coastal towns", "Storm floods northern towns", "Bank merger approved today", "Chip maker opens plant", "Storm hits bank", None]
    names = [["Maine", "Acme"], ["Maine"], ["Acme", "Maine"], ["Acme"], ["Maine", "Bangor"], ["Maine", "Acme"]]
    rows = [(i, titles[i % 6], names[(i // 2) % 6], ts(f"2024-01-{i + 1:02d} 00:00:00"), ts(f"2024-01-{i + 1:02d} 05:00:00")) for i in range(24)]
    frame = spark.createDataFrame(rows, "grp int, title string, entities array<string>, first_at timestamp, last_at timestamp")
    cut = lambda title: set(title or [])
    words = {r.grp: cut(r.w) for r in frame.select("grp", text.title_tokens("title").alias("w")).collect()}
    passes = lambda a, b: len(set(a[2]) & set(b[2])) >= 2 or (len(set(a[2]) & set(b[2])) == 1 and bool(words[a[0]] & words[b[0]]) and 5 * len(words[a[0]] & words[b[0]]) >= len(words[a[0]] | words[b[0]]))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and passes(a, b)}
    past = {(a[0], b[0]) for a in rows for b in rows if b[4] < a[3] and passes(a, b)}
    for common in (1, 200):
        assert {(r.grp, r.other) for r in surfaces.related(frame, 99, common).collect()} == want
        assert {(r.grp, r.other) for r in surfaces.earlier(frame, frame, 99, common).collect()} == past


def test_country_page_shows_no_story_twice(spark):
    sections = ["politics", "business", "technology", "climate", "sports"]
    rows = [(i, i + 1, sections[i % 5], "CA" if i % 2 else "US", "news", 2, 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "grp long, rank int, category string, country string, content_type string, source_count int, n_articles int")
    frame = frame.withColumn("all_release", F.lit(False))
    arts = spark.createDataFrame([(i, i, "CA", ts("2024-01-01 00:00:00") + dt.timedelta(minutes=i)) for i in range(60)], "ord long, grp long, country string, published_at timestamp")
    page = surfaces.country_page(frame, arts, "canada").collect()
    cards = [r.grp for r in page if r.slot not in ("top", "latest")]
    assert len(cards) == len(set(cards)) == 17 and sorted(r.grp for r in page if r.slot == "top") == list(range(1, 20, 2))
    shown = {r.grp for r in page if r.slot != "latest"}
    latest = sorted((r.ord for r in page if r.slot == "latest"), reverse=True)
    assert latest == [i for i in range(59, -1, -1) if i not in shown][:8]
    more = surfaces.more_in_category(frame)
    assert sorted(r.other for r in more.where("grp = 5").collect()) == [0, 10, 15, 20]


def test_stories_without_title_have_earlier_coverage(spark):
    """Two shared names are enough; a null title has no words and loses no story."""
    rows = [(i, None, ["Maine", "Acme"], ts(f"2024-01-0{i} 00:00:00"), ts(f"2024-01-0{i} 05:00:00")) for i in (1, 2, 3)]
    frame = spark.createDataFrame(rows, "grp int, title string, entities array<string>, first_at timestamp, last_at timestamp")
    assert {(r.grp, r.other) for r in surfaces.earlier(frame, frame).collect()} == {(2, 1), (3, 1), (3, 2)}  # none before
