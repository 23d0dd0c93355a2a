"""Secret scans: an Aho-Corasick prefilter, anchored expressions at its hits, then checksums.

One pass of the automaton over a text finds where a keyword stands, in either case; only there
is an expression tried, anchored at the hit.  Three base kinds (assign, access, hex) are kept
by their form alone; long runs of hex digits have no keyword and are found by their length.
Further kinds count only if what they embed is right: the CRC32 at the end of two vendors'
tokens, the JSON header of a web token, the frame of a private key.

Everything runs on UTF-8 bytes, where ASCII patterns match as they do on characters; places
are returned in code points.  Defined results: a null text is an empty one and has no spans;
overlapping spans of different kinds all count, of one kind the leftmost.  A text of any length
is scanned whole, in time that grows with its length; a web token whose header is nested too
deeply to be read is none.  Rows that repeat are scanned one by one; a null doc_id stays null.  An
empty table gives an empty result.  scan() reads no columns but doc_id and text; redact() hands
on all others as they are, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from storyloom.llm.ragged import give_back

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "vendor", "registry", "webtoken", "private_key")
#: The forms of the base kinds, and of the vendors' tokens.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
VENDOR = re.compile(rb"(?:gh[pousr]|npm)_(?P<body>[A-Za-z0-9]{30})(?P<sum>[A-Za-z0-9]{6})(?![A-Za-z0-9])")
WEB_RUN = re.compile(rb"[A-Za-z0-9_-]*")
WEB = re.compile(rb"(?P<head>eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
KEY = re.compile(rb"-----BEGIN (?P<name>[A-Z ]{0,40}PRIVATE KEY)-----")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "vendor": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "registry": ("npm_",),
    "webtoken": ("eyj",),
    "private_key": ("-----begin ",),
}
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MARK = b"[SECRET]"
#: Documents that are rewritten at once.
REDACTED = 512


def base62(number: int, width: int = 6) -> bytes:
    out = b""
    for _ in range(width):
        number, digit = divmod(number, 62)
        out = DIGITS[digit : digit + 1] + out
    return out


def _summed(match: re.Match) -> bool:
    return base62(zlib.crc32(match["body"])) == match["sum"]


def _header(match: re.Match) -> bool:
    head = match["head"]
    try:
        header = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


TESTS = {
    "assign": (ASSIGN, lambda m: len(m["value"]) >= 8),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 16),
    "vendor": (VENDOR, _summed),
    "registry": (VENDOR, _summed),
    "webtoken": (WEB, _header),
    "private_key": (KEY, lambda m: True),
}


class Scanner:
    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()

    def scan(self, raw: bytes) -> list[tuple[int, int, str]]:
        """(start, end, kind) in bytes, by start and then kind."""
        spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
        hits = sorted((end - size + 1, kind) for end, (kind, size) in self.automaton.iter(raw.lower().decode("latin-1")))
        last = dict.fromkeys(KINDS, -1)
        closes: dict[bytes, int] = {}
        for start, kind in hits:
            if start < last[kind]:
                continue
            form, test = TESTS[kind]
            match = form.match(raw, start)
            if match is None:
                if kind == "webtoken":  # what follows the run of letters rules out all starts in it
                    last[kind] = WEB_RUN.match(raw, start).end()
                continue
            end = match.end()
            if kind == "private_key":
                close = b"-----END " + match["name"] + b"-----"
                at = closes.get(close, 0)
                if 0 <= at < end:
                    at = closes[close] = raw.find(close, end)
                end = at + len(close) if at >= 0 else end
            last[kind] = end
            if test(match):
                spans.append((start, end, kind))
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        return spans


def in_characters(raw: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not spans or raw.isascii():
        return spans
    places, at, seen = {}, 0, 0
    for place in sorted({p for s in spans for p in s[:2]}):
        seen += len(raw[at:place].decode("utf-8", "replace"))
        places[place], at = seen, place
    return [(places[a], places[b], kind) for a, b, kind in spans]


def texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            counts, digests, listed = {k: [] for k in BASE}, [], []
            for raw in texts(batch.column(1)):
                spans = in_characters(raw, scanner.scan(raw))
                for k in BASE:
                    counts[k].append(sum(s[2] == k for s in spans))
                digests.append(hashlib.sha256(_listed([s for s in spans if s[2] in BASE]).encode()).hexdigest())
                listed.append(_listed(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(listed, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each run of secrets replaced by a mark, and n_chars, if there, brought up to date."""
    names = docs.columns
    place, sized = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches):
        give_back(kept_too=True)
        scanner = Scanner()
        for batch in (whole.slice(at, REDACTED) for whole in batches for at in range(0, whole.num_rows, REDACTED)):
            old, out, lengths = batch.column(place), [], []
            for valid, raw in zip(old.is_valid().to_pylist(), texts(old)):
                new, at = [], 0
                for a, b, _ in scanner.scan(raw):
                    if a >= at:
                        new += [raw[at:a], MARK]
                    at = max(at, b)
                new = b"".join([*new, raw[at:]]).decode("utf-8", "replace")
                out.append(new if valid else None)
                lengths.append(len(new))
            columns = list(batch.columns)
            columns[place] = pa.array(out, old.type)
            if sized is not None:
                changed = pc.not_equal(pc.fill_null(columns[place], ""), pc.fill_null(old, ""))
                columns[sized] = pc.if_else(changed, pa.array(lengths, pa.int64()).cast(batch.column(sized).type), batch.column(sized))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        give_back()

    return docs.mapInArrow(run, docs.schema).toDF(*names)
