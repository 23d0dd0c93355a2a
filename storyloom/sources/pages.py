"""What pages, sitemaps and images hold."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions import text
from storyloom.functions.text import col
from storyloom.sources.feeds import attribute, tag


def title(html: Column | str) -> Column:
    return text.strip_html(tag(col(html), "title"))


def language(html: Column | str) -> Column:
    return attribute(F.regexp_extract(col(html), r"(?is)<html\b[^>]*>", 0), "lang")


def links(html: Column | str) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), 1)


def meta(html: Column | str, name: str) -> Column:
    element = F.regexp_extract(col(html), rf"(?is)<meta\b[^>]*(?:name|property)=\"{name}\"[^>]*>", 0)
    return attribute(element, "content")


def share_image(html: Column | str, base: Column) -> Column:
    """og:image, a path resolved against the page."""
    found = meta(html, "og:image")
    return F.when(found.startswith("/"), F.concat(F.regexp_extract(base, r"^(https?://[^/]+)", 1), found)).otherwise(found)


def json_ld(html: Column | str) -> Column:
    """Blocks of linked data as variants; null for one that does not parse."""
    return F.transform(F.regexp_extract_all(col(html), F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1), lambda b: F.try_parse_json(b))


def locations(xml: Column | str) -> Column:
    return F.regexp_extract_all(col(xml), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)


def story_locations(xml: Column | str) -> Column:
    return F.filter(locations(xml), lambda u: u.contains("/story/"))


def hero(html: Column | str) -> Column:
    """Addresses of the picture with high priority: src and each of srcset, once."""
    element = F.regexp_extract(col(html), r'(?is)<img\b[^>]*fetchpriority="high"[^>]*>', 0)
    several = F.transform(F.split(F.coalesce(attribute(element, "srcset"), F.lit("")), r"\s*,\s*"), lambda s: F.substring_index(F.trim(s), " ", 1))
    return F.filter(F.array_distinct(F.concat(F.array(attribute(element, "src")), several)), lambda u: u.isNotNull() & (u != ""))


def cards(pages: DataFrame) -> DataFrame:
    """page_id, cluster_id, category, country, sources of each card on list pages."""
    block = F.col("block")
    data = lambda name: attribute(F.regexp_extract(block, r"(?is)^<article\b[^>]*>", 0), f"data-{name}")
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<article\b.*?</article>"), 0)).alias("block"))
    return found.select("page_id", data("cluster").alias("cluster_id"), data("category").alias("category"), data("country").alias("country"), data("sources").try_cast("int").alias("sources"))


_SIZE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


@F.pandas_udf(_SIZE)
def image_size(head: pd.Series) -> pd.DataFrame:
    """Kind and size from the first bytes of a PNG, GIF, JPEG or WebP."""

    def read(b):
        b = bytes(b or b"")
        if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
            return "png", *struct.unpack(">II", b[16:24])
        if b[:4] == b"GIF8" and len(b) >= 10:
            return "gif", *struct.unpack("<HH", b[6:10])
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            if b[12:16] == b"VP8X" and len(b) >= 30:
                return "webp", 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
            if b[12:16] == b"VP8 " and len(b) >= 30:
                w, h = struct.unpack("<HH", b[26:30])
                return "webp", w & 0x3FFF, h & 0x3FFF
            if b[12:16] == b"VP8L" and len(b) >= 25:
                bits = int.from_bytes(b[21:25], "little")
                return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(b):
                if b[at] != 0xFF:
                    break
                mark, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    return "jpeg", int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
                at += 2 + size
        return None, None, None

    return pd.DataFrame([read(b) for b in head], columns=["kind", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


def eligibility(size: Column) -> Column:
    """Flags of a picture's size: aspect, wide, large, shape."""
    w, h = size["width"], size["height"]
    return F.struct(
        (F.floor(w / h * 1000 + 0.5) / 1000).alias("aspect"),
        (w >= 1200).alias("wide"),
        (w.cast("long") * h > 300_000).alias("large"),
        (w / h).between(1.5, 1.91).alias("shape"),
    )
