import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from storyloom.sources import feeds, providers


def item(i):
    return f"<item><title>Title number {i}</title><link>https://e.x/{i}</link><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate></item>"


class Site(BaseHTTPRequestHandler):
    polls: dict = {}

    def do_GET(self):
        n = self.polls[self.path] = self.polls.get(self.path, 0) + 1
        if self.path == "/missing":
            self.send_error(404)
            return
        body = f"<rss><channel><title>Site</title>{''.join(item(i) for i in range(n + 1))}</channel></rss>".encode()
        if self.path == "/long":
            body = f"<rss><channel>{''.join(item(i) for i in range(500))}</channel></rss>".encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    Site.polls = {}
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_two_triggers_from_one_checkpoint(spark, tmp_path, site):
    given = [{"url": f"{site}/a"}, {"url": f"{site}/missing"}, {"url": "ftp://x.y/z"}, {"url": f"{site}/long"}]
    for _ in range(2):
        stream = providers.polls(spark, given, interval=0.5, most_bytes=20_000)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        time.sleep(0.6)
    rows = spark.read.parquet(f"{tmp_path}/out")
    by = {}
    for r in rows.orderBy("tick").collect():
        by.setdefault(r.feed_url, []).append(r)
    assert all(len(r) == 2 and r[0].tick < r[1].tick for r in by.values()) and len(by) == 4
    assert [r.ok for r in by[f"{site}/missing"]] == [False, False] and "404" in by[f"{site}/missing"][0].error and by["ftp://x.y/z"][0].error.startswith("ValueError")
    long = by[f"{site}/long"][0]
    assert long.ok and long.truncated and long.xml.endswith("</item>") and len(long.xml) <= 20_000
    # New items of the second poll once, whatever both polls bring.
    parsed = feeds.items(rows.where(f"feed_url = '{site}/a'").select("feed_url", "xml")).where("accepted")
    assert Site.polls["/a"] == 2 and parsed.count() == 5 and parsed.select("url").distinct().count() == 3


def test_active_providers():
    a, b, mock = (providers.Provider(n, lambda spark: None, lambda on=on: on) for n, on in (("a", False), ("b", True), ("mock", True)))
    assert providers.active([a, b], mock) == [b] and providers.active([a], mock) == [mock] == providers.active([a, b], mock, "mock")
    with pytest.raises(ValueError):
        providers.active([a], mock, "other")


def test_bodies_that_break_off():
    assert providers.whole_items("<rss><item>1</item><item>2") == "<rss><item>1</item>" and providers.whole_items("<rss>") == "<rss>"
