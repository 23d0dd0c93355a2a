"""Providers of articles, and feeds as a stream: spark.readStream.format("feed_polls").

Each trigger polls every feed once, one partition a feed; a feed that fails is a row that says why, and the others go on.  The
offset is a tick of the clock, so a restart goes on after the last committed poll.  A batch that runs again polls again: rows
are told apart by feed and tick, and their items by their addresses, as feeds bring the same items again and again anyway.

Options: feeds (JSON list of objects with url, and user_agent or timeout where a feed needs its own), interval (seconds of a tick),
most_bytes (of a body; what is read by then is kept, cut after its last whole item).
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

TIMEOUT, MOST_BYTES = 8.0, 4_000_000
AGENT = "storyloom/1.0"
SCHEMA = "feed_url string, tick long, ok boolean, error string, truncated boolean, xml string"
_ENDS = re.compile(r"</(?:item|entry)\s*>", re.IGNORECASE)


@dataclass(frozen=True)
class Provider:
    """A named source of raw articles, of which it may have none to read from (configured)."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    configured: Callable[[], bool] = lambda: True


def active(providers: list[Provider], substitute: Provider, mode: str = "live") -> list[Provider]:
    """Those configured, in order of priority; the substitute alone in mode mock, or where none is."""
    if mode not in ("live", "mock"):
        raise ValueError(f"unknown data mode {mode!r}")
    found = [p for p in providers if p.configured()] if mode == "live" else []
    return found or [substitute]


def whole_items(body: str) -> str:
    """A body that broke off, without what stands after its last whole item; as it is if it has none."""
    ends = [m.end() for m in _ENDS.finditer(body)]
    return body[: ends[-1]] if ends else body


def fetch(feed: dict, most: int = MOST_BYTES) -> tuple[str, bool]:
    """(body, whether it broke off). Raises OSError or ValueError where there is no usable answer."""
    if urllib.parse.urlsplit(feed["url"]).scheme not in ("http", "https"):
        raise ValueError("unsupported protocol")
    agent = feed.get("user_agent", AGENT)
    request = urllib.request.Request(feed["url"], headers={"User-Agent": agent} if agent else {})
    limit = float(feed.get("timeout", TIMEOUT))
    until, parts, size, broken = time.monotonic() + limit, [], 0, False
    with urllib.request.urlopen(request, timeout=limit) as answer:
        charset = answer.headers.get_content_charset() or "utf-8"
        try:
            while size <= most and (part := answer.read(1 << 16)):
                parts.append(part)
                size += len(part)
                if time.monotonic() > until:
                    broken = True
                    break
        except OSError:  # what came is worth reading if an item is whole
            broken = True
    raw = b"".join(parts)
    broken |= size > most
    body = raw[:most].decode(charset, "replace")
    if broken and not _ENDS.search(body):
        raise ValueError("broke off before its first item was whole")
    return (whole_items(body), True) if broken else (body, False)


class FeedPolls(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_polls"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedPollReader:
        return FeedPollReader(dict(self.options))


class FeedPollReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.feeds = json.loads(options["feeds"])
        self.interval = float(options.get("interval", 300))
        self.most = int(options.get("most_bytes", MOST_BYTES))

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        return {"tick": int(time.time() / self.interval)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((feed, end["tick"])) for feed in self.feeds]

    def read(self, partition: InputPartition):
        feed, tick = partition.value
        try:
            body, broken = fetch(feed, self.most)
        except (OSError, ValueError, LookupError) as error:
            yield feed.get("url"), tick, False, f"{type(error).__name__}: {error}"[:200], False, None
        else:
            yield feed["url"], tick, True, None, broken, body


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedPolls)


def polls(spark: SparkSession, feeds: list[dict], interval: float = 300, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The stream of polls of these feeds."""
    register(spark)
    return spark.readStream.format("feed_polls").option("feeds", json.dumps(feeds)).option("interval", interval).option("most_bytes", most_bytes).load()
