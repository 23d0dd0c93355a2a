"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom import config
from storyloom.functions.text import col

_PARTS = r"(?i)^\s*(https?)://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(#\S*)?\s*$"


def _part(url: Column | str, group: int) -> Column:
    return F.regexp_extract(col(url), _PARTS, group)


def is_web(url: Column | str) -> Column:
    return col(url).rlike(_PARTS)


def host(url: Column | str) -> Column:
    """Lower case, without www; empty where there is none."""
    return F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", "")


def path(url: Column | str) -> Column:
    trimmed = F.regexp_replace(_part(url, 3), "/+$", "")
    return F.when(~is_web(url), F.lit("(invalid)")).when(trimmed == "", F.lit("/")).otherwise(trimmed)


def canonical(url: Column | str, dropped: tuple[str, ...] = config.TRACKING_PARAMS) -> Column:
    """https, bare host, no fragment, no tracking parameters, no trailing slash; null for what is not http(s)."""
    pairs = F.filter(F.split(F.substring(_part(url, 4), F.lit(2), F.lit(1 << 20)), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*dropped))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit(""))
    place = F.when(_part(url, 3) == "", F.lit("/")).otherwise(_part(url, 3))
    whole = F.concat(F.lit("https://"), host(url), place, query)
    whole = F.when((place == "/") & (query == ""), whole).otherwise(F.regexp_replace(whole, "/$", ""))
    return F.when(is_web(url), whole)


def suffixes(name: Column) -> Column:
    """The host itself and each shorter suffix of two labels or more, the longest first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


#: Kinds of pages that their first segment names itself, and those that several first segments lead to.
OWN_TEMPLATES = ("story", "top-10", "top-100", "briefing", "topic", "source", "reports", "archive", "most-covered", "latest")
SHARED_TEMPLATES = {"country": ("us", "canada"), "index": ("topics", "sources", "search")}


def template(url: Column | str, sections: tuple[str, ...] = config.CATEGORIES, hubs: tuple[str, ...] = tuple(config.HUBS)) -> Column:
    """The kind of page that an address leads to, by the first segment of its path; whatever is deeper belongs to it."""
    first = F.split(path(url), "/")[1]
    out = F.when(path(url) == "/", "home").when(first.isin(*OWN_TEMPLATES), first)
    for name, segments in (SHARED_TEMPLATES | {"section": sections, "hub": hubs}).items():
        out = out.when(first.isin(*segments), F.lit(name))
    return out.otherwise(F.lit("other"))


def story_id(url: Column | str) -> Column:
    found = F.regexp_extract(path(url), "^/story/.*-(c[0-9a-f]{12})$", 1)
    return F.when(found != "", found)


def image_url(url: Column | str, width: int = 1200) -> Column:
    """Ask known image hosts for a wider picture; no bitmap or TIFF."""
    u = col(url)
    sized = F.regexp_replace(u, r"([?&](?:w|width)=)\d+", f"$1{width}")
    return F.when(u.rlike(r"(?i)\.(bmp|tiff?)(\?|$)"), F.lit(None)).when(host(u).rlike(r"^(img|cdn|images)\."), sized).otherwise(u)
