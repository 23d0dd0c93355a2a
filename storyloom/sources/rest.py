"""Paged JSON services as a batch data source: spark.read.format("rest_pages").

Options: url (with {page}), pages, root (name of the list in the answer).  Each page is a partition;
a page that cannot be read gives no rows unless the option strict is true.
"""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RestPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "page int, ord int, title string, url string, description string, published_at string, source string, body string"

    def reader(self, schema) -> RestReader:
        return RestReader(self.options)


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(1, int(self.options.get("pages", 1)) + 1)]

    def read(self, partition: InputPartition):
        options = self.options
        try:
            with urllib.request.urlopen(options["url"].replace("{page}", str(partition.value)), timeout=float(options.get("timeout", 8))) as answer:
                found = json.load(answer)
        except (OSError, ValueError):
            if options.get("strict") == "true":
                raise
            return
        for i, item in enumerate(found.get(options.get("root", "articles"), [])):
            source = item.get("source")
            name = source.get("name") if isinstance(source, dict) else source
            if item.get("title") and item.get("url") and item.get("publishedAt"):
                yield partition.value, i, item["title"], item["url"], item.get("description") or (item.get("content") or "")[:400] or None, item["publishedAt"], name, json.dumps(item)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RestPages)
