"""Descriptions without calls to action, titles without bylines: column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.classify import bind
from storyloom.functions.text import col

#: What invites a reader, where to, and what names the maker of a picture: a sentence that begins with an invitation and names a place is chrome.
INVITATIONS = ("click", "download", "follow", "for more", "for the latest", "get", "join", "listen", "register", "sign up", "subscribe", "tap", "watch")
PLACES = ("app", "article", "blog", "briefing", "channel", "email", "headline", "here", "inbox", "newsletter", "podcast", "story", "update", "website")
ALONE = ("continue reading", "keep reading", "read more", "read on", "read the full", "follow us")
CREDITS = ("composite", "graphic", "illustration", "image", "photo", "photo credit", "photograph")
#: How a newsletter greets, and what it may call its first item.
HELLOS = ("click in for", "thank you for reading", "welcome to", "you are reading", "you['’]re reading")
LETTERS = ("briefing", "digest", "edition", "email", "newsletter")
FIRST_ITEMS = r"(?:the|today['’]s) (?:big|main|top) (?:item|picture|story)"
# The lengths and shares that decide.
ECHO_FRAGMENTS, ECHO_LENGTH = 4, 60
SHOUTED_LENGTH, SHOUTED_SHARE = 80, 0.9
TITLE_LEFT = 8
#: A mark that a template left in a text.
TEMPLATE_TOKEN = r"\{[a-z][a-z0-9_-]{1,23}\}"
#: Words of sections and series, which a bar at the end of a title may name as well as a person.
SECTION_WORDS = ("analysis", "briefing", "cup", "editorial", "football", "hockey", "league", "live", "newsletter", "news", "photos", "podcast", "review", "series", "soccer", "sport", "sports", "updates", "video", "weekly")
_NAME = r"\p{Lu}[\p{L}'’.-]+"
BYLINE = rf"\|\s*({_NAME}(?:\s+(?:{_NAME}|and|&)){{1,4}})\s*$"


@dataclass(frozen=True)
class Chrome:
    """What publishers put around a text, as patterns that a sentence begins with (greetings, openers), ends with or contains."""

    greetings: tuple[str, ...]
    openers: tuple[str, ...]
    trailing: str
    heading: str

    @property
    def greeting(self) -> str:
        return f"(?i)^(?:{'|'.join(self.greetings)})"

    @property
    def all(self) -> str:
        return f"(?i)^(?:{'|'.join(self.greetings + self.openers)})"


def chrome(invitations=INVITATIONS, places=PLACES, alone=ALONE, credits=CREDITS, hellos=HELLOS, letters=LETTERS, first_items: str = FIRST_ITEMS) -> Chrome:
    """Patterns from vocabularies."""
    any_of = lambda words: f"(?:{'|'.join(words)})"
    greetings = (rf"{any_of(hellos)}\b[^.!?\n]{{0,80}}\b{any_of(letters)}\b", rf"{hellos[0]}\b")
    openers = (rf"{any_of(invitations)}\b[^.!?\n]*\b{any_of(places)}s?\b", rf"{any_of(alone)}\b", rf"(?:©\s*)?{any_of(credits)}\s*:")
    return Chrome(greetings, openers, rf"{any_of((*alone[:3], 'click here'))}[\s.…]*$", rf"^{first_items}\b[\s:–—-]*")


USUAL = chrome()

SPACES = r"\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LAYOUT = r"\x{2007}-\x{200B}"


def _members(ranges: str) -> str:
    """The characters of a class that is written as code points and ranges of them."""
    ends = [[int(x, 16) for x in re.findall(r"\\x\{([0-9A-F]+)\}", part)] for part in re.findall(r"\\x\{[0-9A-F]+\}(?:-\\x\{[0-9A-F]+\})?", ranges)]
    return "".join(chr(c) for e in ends for c in range(e[0], e[-1] + 1))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(_members(SPACES)))


def boundaries(text: Column) -> Column:
    """Template tokens and runs of layout spaces as line ends; a lone no-break space stays.

    A run is looked at from its start only, and never twice, so long runs take linear time. Texts without the character
    that a run needs are left alone.
    """
    text = F.when(F.contains(text, F.lit("{")), F.regexp_replace(text, TEMPLATE_TOKEN, "\n")).otherwise(text)
    layout = lambda t: F.when(t.rlike(f"[{LAYOUT}]"), F.regexp_replace(t, f"(?<![{SPACES}])[{SPACES}&&[^{LAYOUT}]]*+[{LAYOUT}][{SPACES}]*+", "\n")).otherwise(t)
    hard = lambda t: F.when(F.contains(t, F.lit("\xa0")), F.regexp_replace(t, rf"(?<![{SPACES}])(?=[{SPACES}]{{2}})[{SPACES}&&[^\x{{A0}}]]*+\x{{A0}}[{SPACES}]*+", "\n")).otherwise(t)
    return bind([bind([text], layout)], hard)


def sentences(text: Column) -> Column:
    """array<string>: parts between line ends and after closing marks, without empty ones."""
    lines = F.split(F.regexp_replace(text, f"(?<=[.!?…])[{SPACES}]+", "\n"), "\n")
    return F.filter(F.transform(lines, stripped), lambda s: s != "")


def shouted(text: Column) -> Column:
    """A long sentence almost all of whose letters are capitals: legal text.

    Letters are counted only where the first ones leave it open: more small ones than a shouted sentence has decide.
    """
    count = lambda kind: F.regexp_count(text, F.lit(rf"\p{{{kind}}}"))
    small = F.regexp_count(F.substring(text, 1, SHOUTED_LENGTH), F.lit("[a-z]"))
    open_ = small <= F.length(text) * (1 - SHOUTED_SHARE) + 1e-6
    return (F.length(text) > SHOUTED_LENGTH) & open_ & (count("L") > 0) & (count("Lu") > count("L") * SHOUTED_SHARE)


def description(text: Column | str, domain: Column | str | None = None, known: Chrome = USUAL, publishers: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The text without sentences of chrome; '' where nothing else stands, null for null.

    publishers: for a domain (those below it included) patterns that are taken out of its texts wherever they stand.

    After a newsletter's greeting, short headings without a mark are dropped too until the first sentence.
    Repeating it changes nothing.
    """
    text = col(text)
    if domain is not None:
        host = F.coalesce(F.regexp_replace(F.lower(col(domain)), r"^www\.", ""), F.lit(""))
        for name, patterns in (publishers or {}).items():
            plain = F.regexp_replace(text, f"(?i)(?:{'|'.join(patterns)})", " ")
            text = F.when(host.rlike(rf"(^|\.){name.replace('.', '[.]')}$"), F.regexp_replace(plain, "[ \t]{2,}", " ")).otherwise(text)
    parts = sentences(stripped(F.regexp_replace(boundaries(text), f"(?i){known.trailing}", "")))

    def joined(found: Column) -> Column:
        greeted = F.coalesce(F.get(found, F.lit(0)).rlike(known.greeting), F.lit(False))
        placed = F.transform(found, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
        kept = F.filter(placed, lambda p: ~p["s"].rlike(known.all) & ~shouted(p["s"]))
        own = lambda s: stripped(F.regexp_replace(s, f"(?i){known.heading}", ""))
        echo = lambda p: (p["i"] < ECHO_FRAGMENTS) & (F.length(p["s"]) <= ECHO_LENGTH) & ~p["s"].rlike("[.!?…]")
        body = bind([kept], lambda k: F.slice(k, F.coalesce(F.nullif(F.array_position(F.transform(k, lambda p: echo(p) | (own(p["s"]) == "")), False), F.lit(0)), F.size(k) + 1).cast("int"), F.greatest(F.size(k), F.lit(1))))
        led = bind([body], lambda b: F.transform(b, lambda p, i: F.when(i == 0, own(p["s"])).otherwise(p["s"])))
        return F.array_join(F.when(greeted, led).otherwise(F.transform(kept, lambda p: p["s"])), " ")

    return F.when(text.isNull(), F.lit(None).cast("string")).otherwise(bind([parts], joined))


def has_byline(title: Column | str) -> Column:
    """Whether a title ends in a bar and the name of a person, not of a section."""
    name = F.regexp_extract(col(title), BYLINE, 1)
    return (name != "") & ~name.rlike(rf"(?i)\b(?:{'|'.join(SECTION_WORDS)})\b")


def display_title(title: Column | str) -> Column:
    """The title without its byline, unless too little would be left."""
    whole = stripped(col(title))
    short = stripped(F.regexp_replace(whole, r"\|[^|]*$", ""))
    return F.when(has_byline(title) & (F.length(short) >= TITLE_LEFT), short).otherwise(whole)
