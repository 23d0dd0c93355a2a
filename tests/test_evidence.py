"""Details, dictionaries, audits, discovery, JSON and topics on small inputs with known results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import audits, corroborate, dictionary, discovery, json_history, topics


def ts(s):
    return dt.datetime.fromisoformat(s)


@pytest.mark.parametrize(
    "given,want",
    [
        ("They paid $2 billion and US$40m, or CA$1.2 million.", ["$2 billion", "US$40m", "CA$1.2 million"]),
        ("An 18-year-old and a 6-month-old won 45% or 4.5 percent.", ["18-year-old", "6-month-old", "45%", "4.5 percent"]),
        ("In the 2026 season 8 games, 3 of 12,500 people and 3.5 million saw 2 more", ["8 games", "12,500 people"]),
        ("", []),
    ],
)
def test_figures(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(corroborate.figures("t").alias("f")).first().f == want


def story(spark, members, title="Ferry sinks", names=("Harbor",)):
    schema = "grp string, ord long, domain string, source string, title string, description string, entities array<string>, content_type string"
    rows = spark.createDataFrame([("s", i, d, d.upper(), t, x, e, k) for i, (d, t, x, e, k) in enumerate(members)], schema)
    leads = spark.createDataFrame([("s", title, list(names))], "grp string, title string, entities array<string>")
    generic = spark.createDataFrame([("Canada",)], "name string")
    return [(r.phrase, r.sources) for r in corroborate.details(rows, leads, generic).orderBy("rank").collect()]


def test_details_need_two_domains_and_no_press_release(spark):
    members = [
        ("a.x", "Ferry sinks", "The Ferry sinks with 40 people near Harbor, Canada, says Ann Lee.", ["Ann Lee", "Harbor", "Canada", "Ferry"], "news"),
        ("b.x", "Boat lost", "About 40  people were aboard, ANN LEE said in Canada. Cost: $2 million", ["Canada"], "news"),
        ("a.x", "More", "The loss is $2 million", [], "news"),
        ("c.x", "PR", "Cost: 7 boats", [], "press_release"),
        ("d.x", None, "7 boats", [], "news"),
    ]
    assert story(spark, members) == [("Ann Lee", ["A.X", "B.X"]), ("40 people", ["A.X", "B.X"]), ("$2 million", ["B.X", "A.X"])]
    assert story(spark, members[:1] + [(*members[0][:4], "press_release")]) == []


def test_phrases_are_found_within_longer_words(spark):
    long = "z" * 100 + "needle" + "y" * 200
    phrases = ["art", "8 game", "a-b", "ann lee", "needle", "%", "é", "x y z", "z" * 80]
    docs = ["smart", "18 games", "qa-bc", "joann leeds", long, "5%", "café", "ax y zb x  y z", "8 gam", "art", "", "x y y z"]
    wanted = spark.createDataFrame([("g", p) for p in phrases], "grp string, key string")
    texts = spark.createDataFrame([("g", i, t) for i, t in enumerate(docs)] + [("h", 99, "art")], "grp string, ord long, lower string")
    got = {(r.key, r.ord) for r in corroborate.containing(wanted, texts).collect()}
    assert got == {(p, i) for p in phrases for i, t in enumerate(docs) if p in t and p != "%"}


TERMS = [("rate", "x"), ("interest rate", "x"), ("rate cut", "y"), ("ai", "x"), ("gm", "x"), ("New  York", "y")]


def test_terms_stand_between_other_characters(spark):
    texts = spark.createDataFrame([(1, "Said GM: interest rates, rate cuts"), (2, "gmail interest-rate said"), (3, "NEW YORK interest  rate"), (4, None), (5, "ai"), (6, "interest rate cut")], "ord long, t string")
    terms = spark.createDataFrame([(t,) for t, _ in TERMS], "term string")
    got = {(r.ord, r.term) for r in dictionary.distinct_hits(texts, terms, ["ord"], "t").collect()}
    assert got == {(1, "gm"), (1, "rate"), (1, "interest rate"), (1, "rate cut"), (2, "rate"), (3, "rate"), (3, "New  York"), (5, "ai"), (6, "rate"), (6, "interest rate"), (6, "rate cut")}
    found = dictionary.matches(texts, terms, ["ord"], "t")
    kept = {(r.ord, r.term) for r in dictionary.resolved(found, ["ord"]).collect()}
    assert kept == {(1, "gm"), (1, "interest rate"), (1, "rate cut"), (2, "rate"), (3, "rate"), (3, "New  York"), (5, "ai"), (6, "interest rate")}
    assert dictionary.distinct_hits(texts, terms.limit(0), ["ord"], "t").count() == 0


def test_sections_ties_and_exclusions(spark):
    rows = [(1, "bank profit", "vote"), (2, "vote bank", ""), (3, "vote bank", "a million"), (4, "", "vote"), (5, "vote satire", "vote"), (6, None, None)]
    articles = spark.createDataFrame(rows, "ord long, title string, description string")
    terms = spark.createDataFrame([("bank", "business", 1), ("profit", "business", 1), ("vote", "politics", 1), ("satire", "politics", -2)], "term string, category string, weight int")
    money = F.coalesce(F.col("description"), F.lit("")).contains("million")
    got = {r.ord: (r.category, round(r.confidence, 4), r.categories) for r in dictionary.sections(articles, terms, money).collect()}
    assert got[1] == ("business", round(5 / 6, 4), ["business"]) and got[2] == ("general", 0.0, ["general", "business", "politics"])
    assert got[3] == ("business", 0.0, ["business", "politics"]) and got[4] == ("general", 0.0, ["general"]) == got[6] and got[5][0] == "general"


def test_aliases_count_as_their_names(spark):
    articles = spark.createDataFrame([(1, "The Fed and NASA meet", "federal reserve"), (2, "Inflation", "nfl")], "ord long, title string, description string")
    names = spark.createDataFrame([("NASA", 0), ("NFL", 1), ("Federal Reserve", 2)], "name string, place int")
    aliases = spark.createDataFrame([("the fed", "Federal Reserve", 2)], "alias string, name string, place int")
    assert {r.ord: r.entities for r in dictionary.named(articles, names, aliases).collect()} == {1: ["NASA", "Federal Reserve"], 2: ["NFL"]}


def mulberry32(seed):
    a = seed & 0xFFFFFFFF
    imul = lambda x, y: (x * y) & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = imul(a ^ a >> 15, a | 1)
        t ^= (t + imul(t ^ t >> 7, t | 61)) & 0xFFFFFFFF
        yield ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


@pytest.mark.parametrize("seed", [0, 1, 20260828, 4294967295])
def test_draws_are_the_generators(spark, seed):
    generator = mulberry32(seed)
    assert [r.d for r in spark.range(1, 60).orderBy("id").select(audits.draw(seed, F.col("id")).alias("d")).collect()] == [next(generator) for _ in range(59)]


def test_samples_have_their_exact_sizes(spark):
    rows = spark.range(3000).withColumn("s", F.when(F.col("id") < 7, "few").when(F.col("id") < 400, "some").otherwise("many"))
    quotas = spark.createDataFrame([("few", 10), ("some", 30), ("many", 50)], "s string, k int")
    one, two = (sorted(r.id for r in audits.bottom_k(rows.repartition(n), "s", quotas, "id", 5).collect()) for n in (1, 7))
    assert one == two and len(one) == 87
    assert sorted(r.id for r in audits.bottom_k(rows, "s", quotas, "id", 6).collect()) != one
    sizes = lambda n, size: {r["_many"]: r["count"] for r in audits.balanced_sample(rows, F.col("id") < n, "id", size, 1).groupBy("_many").count().collect()}
    assert sizes(500, 100) == {True: 50, False: 50} and sizes(20, 100) == {True: 20, False: 80} and sizes(2990, 100) == {True: 90, False: 10}


def test_as_of_hands_values_over_stretches(spark):
    rng = random.Random(3)
    moment = lambda: ts("2024-01-01") + dt.timedelta(minutes=rng.randrange(60 * 24 * 40))
    left = [(i, rng.randrange(3), moment()) for i in range(300)]
    right = [(rng.randrange(3), moment(), rng.randrange(100)) for _ in range(25)] + [(0, left[0][2], 7), (0, left[0][2], 9)]
    left[0] = (0, 0, left[0][2])
    got = {r.i: (r.right_at, r.right_v) for r in discovery.asof(spark.createDataFrame(left, "i int, k int, at timestamp"), spark.createDataFrame(right, "k int, at timestamp, v int"), "k", "at", ["v"]).collect()}
    assert got == {i: max(((a, v) for k2, a, v in right if k2 == k and a <= at), default=(None, None)) for i, k, at in left} and got[0] == (left[0][2], 9)


def test_early_discovery_without_stories(spark):
    empty = spark.createDataFrame([], "id long, published_at timestamp")
    days = spark.createDataFrame([(1, dt.date(2024, 1, 1), 3)], "id long, day date, impressions int")
    row = discovery.early_discovery(empty, days, F.lit("2024-02-01").cast("timestamp")).first()
    assert (row.eligible, row.discovered, row.discovered_pct, row.median_hours) == (0, 0, None, None)


def test_malformed_json_counts_nothing(spark):
    history = '[{"kind":"coverage_change","from":2,"to":"9"},{"kind":"coverage_change","from":"-4","to":"99999999999"},{"kind":"other","to":50},7,null]'
    rows = [
        (1, '[{"name":" A ","firstSeenAt":null},{"name":"A"},{"name":""},{"url":"u"},5]', history),
        (2, '{"name":"x"}', "[]"), (3, '[{"name":', "nonsense"), (4, None, None), (5, "[]", '"text"'),
    ]
    got = {r.key: (r.union_sources, r.union_publications, r.stamped, r.peak_history, r.history_events) for r in json_history.union_rows(spark.createDataFrame(rows, "key int, sources string, history string")).collect()}
    assert got == {1: (5, 1, True, 9, 5), 2: (0, 0, False, None, 0), 3: (0, 0, False, None, 0), 4: (0, 0, False, None, 0), 5: (0, 0, False, None, 0)}
    stories = spark.createDataFrame([("c1", "T", ts("2024-01-01 10:00:00"), ts("2024-01-02"), 2, '[{"name":"A"}]', '["X","Y"]', "")], "cluster_id string, title string, first_seen timestamp, last_modified timestamp, source_count int, sources string, entities string, merged_into string")
    row = json_history.as_story(stories).first()
    assert (row.first_seen_at, row.source_names, row.entity_names, row.merged_into) == ("2024-01-01T10:00:00.000Z", ["A"], ["X", "Y"], None)


@pytest.mark.parametrize("word,want", [("wildfire", ["wildfires"]), ("city", ["citys", "cities"]), ("box", ["boxs", "boxes"]), ("cities", ["citiess", "citieses", "city", "citie"]), ("glass", ["glasss", "glasses"]), ("churches", ["churchess", "churcheses", "church", "churche"]), ("is", ["iss", "ises"])])
def test_plural_variants(spark, word, want):
    assert spark.createDataFrame([(word,)], "w string").select(text.plural_variants(F.col("w")).alias("v")).first().v == want


def test_spellings_of_a_topic_share_its_key(spark):
    curated = spark.createDataFrame([("Wildfires", 0), ("Federal Reserve", 1), ("City", 2), ("Cities", 3)], "name string, place int")
    aliases = spark.createDataFrame([("the fed", "Federal Reserve")], "alias string, name string")
    names = ["Wildfire", "wildfires", "The Fed", "Federal Reserves", "Giants", "Banff National Park", "Banff", "Cities", "city", "Café Région", "!!", "O’Hare"]
    got = {r.name: r.key for r in topics.with_keys(spark.createDataFrame([(n,) for n in names], "name string"), curated, aliases).collect()}
    assert got == {"Wildfire": "wildfires", "wildfires": "wildfires", "The Fed": "federal-reserve", "Federal Reserves": "federal-reserve", "Giants": "giants", "Banff National Park": "banff", "Banff": "banff", "Cities": "cities", "city": "city", "Café Région": "cafe", "O’Hare": "ohare"}
    mentions = topics.with_keys(spark.createDataFrame([(1, "Wildfire"), (2, "Wildfires"), (2, "wildfires"), (3, "Banff"), (4, "Banff National Park")], "grp int, name string"), curated, aliases)
    known = topics.directory(mentions)
    found = {r.key: (r.display, r.n_stories, r.curated, r.eligible) for r in known.collect()}
    assert found == {"wildfires": ("Wildfire", 2, True, True), "banff": ("Banff National Park", 2, False, True)}
    asked = spark.createDataFrame([(s,) for s in ("banff", "banff-national-park", "wildfire", "nowhere")], "slug string")
    assert {(r.slug, r.key, r.by) for r in topics.resolved(asked, known, curated, aliases).collect()} == {("banff", "banff", "variant"), ("banff-national-park", "banff", "variant"), ("wildfire", "wildfires", "variant")}


def test_pages_against_rows(spark):
    rows = spark.createDataFrame([(None, 2), (2, 2), (3, 2), (1, 2)], "r int, u int")
    assert [r[0] for r in rows.select(audits.relation(F.col("r"), F.col("u"))).collect()] == ["unparsed", "match", "page-renders-more", "page-renders-fewer"]


@pytest.mark.parametrize("looks", [(1,), (2, 3), (16, 256), ()])
def test_first_members_are_looked_at_first(spark, monkeypatch, looks):
    """Details are those of all phrases, however many members are looked at first; a story that its first names fill asks for no more."""
    names = ["Ann Lee", "Bob Ray", "Cy Young", "Dee Dow", "Eve Oak", "Flo Pine", "Gus Reed", "Hal Sand"]
    members = [(f"{'abc'[i % 3]}.x", "Ferry", f"{' and '.join(names[i:])} saw {i + 2} boats, 9 cars", names[i:][: 3 if i else 1], "news") for i in range(8)]
    seen = []
    told = corroborate._told
    monkeypatch.setattr(corroborate, "_told", lambda wanted, *more: seen.append(wanted.count()) or told(wanted, *more))
    monkeypatch.setattr(corroborate, "LOOKS", looks)
    found = story(spark, members)
    assert found == [(n, ["A.X", "B.X", "C.X"][: i + 1]) for i, n in enumerate(names[1:7], 1)]
    if looks == (2, 3):
        assert len(seen) == 3 and seen[0] < seen[1] < seen[2]
    if looks == (16, 256):
        assert len(seen) == 1 and seen[0] == len(names)  # figures as well, and twice all texts, before
