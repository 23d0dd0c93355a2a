import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.functions import classify, cleaning, dates, scores, text, urls
from storyloom.sources import feeds
from storyloom.sources import pages as page


def each(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression.alias("y")).collect()]


@pytest.mark.parametrize("given,want", [("Héllo, World's End!", "hello-worlds-end"), ("---", "story"), ("a" * 90, "a" * 80), ("x " * 50, ("x-" * 40)[:79])])
def test_slugify(spark, given, want):
    assert each(spark, [given], text.slugify("x")) == [want]


def test_stems(spark):
    words = ["cities", "glasses", "press", "virus", "running", "stopped", "calling", "carried", "narrowly", "early", "release", "released", "cat"]
    want = ["city", "glass", "press", "virus", "run", "stop", "call", "carry", "narrow", "early", "releas", "releas", "cat"]
    assert each(spark, words, text.stem(F.col("x"))) == want
    assert each(spark, ["kidnapped", "kidnapping", "kidnaps", "boss"], text.title_stem(F.col("x"))) == ["kidnap", "kidnap", "kidnap", "boss"]


def test_fnv1a(spark):
    def plain(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) % (1 << 32)
        return f"{h:08x}"

    words = ["", "a", "Customer#1", "wire"]
    assert each(spark, words, text.fnv1a("x")) == [plain(w) for w in words]


def test_meta_description_keeps_sentences(spark):
    short = "One short text."
    long = "First sentence here. " + "Second one follows it. " * 10
    got = each(spark, [short, long, "word " * 60], text.meta_description("x"))
    assert got[0] == short and got[1].endswith(".") and len(got[1]) <= 155 and got[2].endswith("…") and len(got[2]) <= 156


def test_truncate_and_tokens(spark):
    assert each(spark, ["abc def"], text.truncate("x", 20)) == ["abc def"]
    assert each(spark, ["aaaa bbbb cccc"], text.truncate("x", 11)) == ["aaaa bbbb…"]
    assert each(spark, ["The city's 2 big-storms and I"], text.tokens("x")) == [["citys", "big", "storms"]]
    assert each(spark, ["Storms hit", "hit"], text.bigrams(text.tokens("x"))) == [["storms hit"], []]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=6), st.lists(st.sampled_from("abcdef"), max_size=6))
def test_jaccard_bounds(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(text.jaccard(F.col("a"), F.col("b"))).first()[0]
    want = len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0
    assert abs(row - want) < 1e-12


def test_urls(spark):
    given = ["HTTP://WWW.Example.com/a/?utm_source=x&id=2#top", "https://example.com", "ftp://x.y/z", "not a url", "https://a.b/c/?ref=1", "https://m.a.b/?q=1"]
    assert each(spark, given, urls.canonical("x")) == ["https://example.com/a/?id=2", "https://example.com/", None, None, "https://a.b/c", "https://m.a.b/?q=1"]
    assert each(spark, given[:2], urls.canonical(urls.canonical("x"))) == each(spark, given[:2], urls.canonical("x"))
    assert each(spark, ["a.b.co.uk", "x.y", "single"], urls.suffixes(F.col("x"))) == [["a.b.co.uk", "b.co.uk", "co.uk"], ["x.y"], ["single"]]
    assert each(spark, ["https://x.y/story/some-title-c0123456789ab", "https://x.y/topic/z"], urls.template("x")) == ["story", "topic"]
    assert each(spark, ["https://x.y/story/some-title-c0123456789ab"], urls.story_id("x")) == ["c0123456789ab"]


def test_html(spark):
    got = each(spark, ["<p>A &amp;lt; B</p><p>C<br>D</p><script>x()</script> &nbsp; E"], text.strip_html("x"))
    assert got == ["A < B\nC\nD\nE"]


def test_dates(spark):
    stamp = F.to_timestamp("x")
    assert [str(d) for d in each(spark, ["2024-01-01 04:59:00", "2024-07-01 03:59:00"], dates.news_day(stamp))] == ["2023-12-31", "2024-06-30"]
    assert each(spark, ["2024-12-30", "2021-01-03"], dates.week_id(F.to_date("x"))) == ["2025-W01", "2020-W53"]
    assert each(spark, ["2024-01-30T10:00:00Z", "2024-01-30", "nonsense"], dates.instant("x").isNotNull()) == [True, True, False]
    assert each(spark, [5, 198, 3060], text.duration(F.col("x")), "int") == ["5 min", "3h 18m", "2d 3h"]


def test_scores(spark):
    assert each(spark, [-1.0, 8.0, 60.0, 72.0], F.round(scores.freshness(F.col("x")), 6), "double") == [1.0, 0.5, round(0.5**7.5 * 0.5, 6), 0.0]
    assert each(spark, [1, 12, 40], F.round(scores.coverage(F.col("x")), 6), "int") == [0.2, 1.0, 1.0]
    assert each(spark, [0.25, -0.25, 1.05], scores.rounded(F.col("x")), "double") == [0.3, -0.2, 1.1]


def test_classifiers(spark):
    rows = spark.createDataFrame([("Senate vote on the election", "The minister spoke in parliament", "a.b"), ("Opinion: what it means", "text", "a.b"), ("Acme profit up", "press release by acme", "a.b"), ("Live updates: x", "", "x.wire.example.org")], "t string, d string, h string")
    found = rows.select(classify.content_type("t", "d", "h").alias("k"), classify.category(classify.category_scores("t", "d"), classify.money(F.col("t")))["category"].alias("c")).collect()
    assert [r.k for r in found] == ["news", "opinion", "press_release", "press_release"]
    assert found[0].c == "politics"


FEED = """<rss><channel><item><title><![CDATA[A <b>bold</b> title]]></title><link>https://x.y/1</link><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate>
<media:content url="https://i.x/a.jpg" width="300"/><media:content url="https://i.x/b.jpg" width="900"/></item>
<item><title>No link</title><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>Bad date</title><link>https://x.y/3</link><pubDate>soon</pubDate></item></channel></rss>"""
ATOM = """<feed><entry><title>Atom</title><link href="https://x.y/a"/><updated>2024-01-30T10:00:00Z</updated><summary>&lt;img src="https://i.x/c.png"&gt; text</summary></entry></feed>"""


def test_feeds(spark):
    bodies = spark.createDataFrame([("r", FEED), ("a", ATOM), ("e", ""), ("n", None)], "feed_url string, xml string")
    rows = feeds.items(bodies).orderBy("feed_url", "ord").collect()
    assert [(r.title, r.accepted) for r in rows] == [("Atom", True), ("A bold title", True), ("No link", False), ("Bad date", False)]
    assert rows[1].image_url == "https://i.x/b.jpg" and rows[0].image_url == "https://i.x/c.png" and rows[0].url == "https://x.y/a"
    health = {r.feed_url: (r.items_parsed, r.items_skipped, r.ok) for r in feeds.health(bodies.select("feed_url"), feeds.items(bodies)).collect()}
    assert health == {"r": (1, 2, True), "a": (1, 0, True), "e": (0, 0, False), "n": (0, 0, False)}


def test_isolated_sources(spark):
    good, status = feeds.union_isolated({"a": lambda: spark.range(2), "b": lambda: spark.read.parquet("/nowhere"), "c": lambda: spark.range(1)})
    assert good.count() == 3 and [s[1] for s in status] == ["ok", "failed", "ok"]


def test_pages(spark):
    html = '<html lang="en"><meta property="og:image" content="/p.jpg"><article data-cluster="c1" data-category="world" data-sources="3">x</article><script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">{bad</script>'
    rows = spark.createDataFrame([(1, html, "https://x.y/z")], "page_id int, html string, url string")
    r = rows.select(page.language("html"), page.share_image("html", F.col("url")), F.transform(page.json_ld("html"), lambda v: v.isNull())).first()
    assert tuple(r) == ("en", "https://x.y/p.jpg", [False, True])
    assert page.cards(rows).first()[1:] == ("c1", "world", None, 3)


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 10, 20)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">H", 11) + b"\x08" + struct.pack(">HH", 300, 500) + b"\x03"
    webp = b"RIFF" + b"\0" * 4 + b"WEBPVP8X" + b"\0" * 8 + (799).to_bytes(3, "little") + (599).to_bytes(3, "little")
    got = each(spark, [bytearray(x) for x in (png, gif, jpeg, webp, b"junk")], page.image_size("x"), "binary")
    assert [tuple(g) for g in got] == [("png", 640, 480), ("gif", 10, 20), ("jpeg", 500, 300), ("webp", 800, 600), (None, None, None)]
    assert zlib.crc32(png)  # a fixture, not a file


def test_words_are_found_anywhere_in_a_text(spark):
    terms = ("goal", "goals", "north sea", "class")
    rows = spark.createDataFrame([("x " * 4000 + "goals in the north seas",), ("classes, subgoal; goalkeeper north  sea",), ("class-goal",), ("",)], "t string")
    found = [sorted(r.h) for r in rows.select(classify.hits(F.col("t"), terms).alias("h")).collect()]
    assert found == [["goal", "goals", "north sea"], [], ["class", "goal"], []]
    far = spark.createDataFrame([("News", "word " * 900 + "senate election")], "t string, d string")
    scores = far.select(classify.category_scores("t", "d").alias("s")).first().s
    assert {s.category: s.score for s in scores}["politics"] == 2


def test_cleaning_reads_each_character_a_few_times(spark):
    """Ends are cut without patterns that look back at every character; what is shouted is told from the first letters or by counts alike."""
    texts = ["\u2003 a b \u3000\ufeff", "a \u0085", " \u200b ", ""]
    assert "regexp" not in str(cleaning.stripped(F.col("x"))).lower()  # two patterns before
    assert each(spark, texts, cleaning.stripped(F.col("x"))) == ["a b", "a \u0085", "", ""]  # "a" before the line end that SQL knows none of
    loud = [("A" * up + "b" * low + "." * rest) for up, low, rest in ((90, 10, 0), (91, 9, 0), (91, 9, 900), (900, 101, 0), (902, 98, 0), (0, 0, 90), (72, 8, 1), (73, 8, 0))]
    loud += [s[::-1] for s in loud]
    plain = [len(s) > 80 and s.count("A") > 0.9 * (s.count("A") + s.count("b")) and "A" in s for s in loud]
    assert each(spark, loud, cleaning.shouted(F.col("x"))) == plain and any(plain) and not all(plain)
    small = ["{a} x", "a{now}b", "a\u2009b", "a \xa0b", "a\xa0b"]
    assert each(spark, small, cleaning.boundaries(F.col("x"))) == ["{a} x", "a\nb", "a\nb", "a\nb", "a\xa0b"]


def test_descriptions_without_chrome(spark):
    rows = {
        "Real news here. Sign up for our newsletter today! More facts.": "Real news here. More facts.",
        "Officials asked residents to sign up for alerts.": "Officials asked residents to sign up for alerts.",
        "Welcome to the new era of flight": "Welcome to the new era of flight",
        "Welcome to The Daily briefing\nDefense & Security\nThe Big Story: Amid rain, he left.\nShort line\nClick in for more": "Amid rain, he left. Short line",
        "Before {beacon} after 10\u00a0000 people \u00a0 Next\u2009 tail. Continue reading...": "Before after 10\u00a0000 people Next tail.",
        "ALL TERMS OF THE PROSPECTUS AND OF ITS SUPPLEMENTS ARE AVAILABLE FROM THE ISSUER ON REQUEST NOW. Fine.": "Fine.",
        "Read more": "",
        "": "",
    }
    frame = spark.createDataFrame([(t, w) for t, w in rows.items()] + [(None, None)], "t string, want string")
    found = frame.select("want", cleaning.description("t").alias("once")).select("want", "once", cleaning.description("once").alias("twice")).collect()
    assert [r.once for r in found] == [r.want for r in found] == [r.twice for r in found]
    one = spark.createDataFrame([("It rains today sign up for the daily email. End", "www.one.example.com"), ("It rains today sign up for the daily email. End", "a.b")], "t string, d string")
    assert [r[0] for r in one.select(cleaning.description("t", "d", publishers={"one.example.com": (r"sign up for [^.!?\n]{0,60}?email[.!]?",)})).collect()] == ["It rains today End", "It rains today sign up for the daily email. End"]


def test_titles_without_bylines(spark):
    titles = ["Why we left the city | Jane Doe", "Rovers win | Premier League", "Hi | Jane Doe", "Plain ", "Two | bars | Anna O’Neil", None]
    found = spark.createDataFrame([(t,) for t in titles], "t string").select(cleaning.display_title("t")).collect()
    assert [r[0] for r in found] == ["Why we left the city", "Rovers win | Premier League", "Hi | Jane Doe", "Plain", "Two | bars", None]


def test_real_words_decide_sections_and_places(spark):
    rows = [("Prime minister calls referendum", "Voters go to the ballot", "politics", "GLOBAL"), ("Playoff goal sends Toronto through", "The coach praised the striker", "sports", "CA"), ("Then that the or", "ing ung tion ther", "general", "GLOBAL")]
    frame = spark.createDataFrame(rows, "t string, d string, c string, p string")
    found = frame.select("c", "p", classify.category(classify.category_scores("t", "d"), classify.money(F.col("t")))["category"].alias("x"), classify.country("t", "d")["country"].alias("y")).collect()
    assert [(r.x, r.y) for r in found] == [(r.c, r.p) for r in found]
