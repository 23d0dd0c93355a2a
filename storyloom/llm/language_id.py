"""Language identification by a string kernel.

The kernel of two texts is the blended spectrum of their character n-grams (n = 1, 2, 3) by
presence: ``1/3 * sum over n of |P_n(x) & P_n(z)| / sqrt(|P_n(x)| * |P_n(z)|)``.  Landmarks,
a few training texts of each language, span a Nystroem feature map; one-versus-rest ridge
regression in it gives one score a language.  The kernel is linear in a text's scaled presence
vector, so the map and the regression fold into one matrix, and a batch of texts is scored by
one product of its presence matrix with it.

The classifier is fitted on a bounded sample: at most PER_LANGUAGE rows of each language and SAMPLE rows in
all, but one of every language at least, chosen by a hash of doc_id among rows that are not held out.  Every
label is learned; more than LABELS of them are refused.  Prediction reads whole texts and nothing but texts.

Letters are their lower-case code points; everything between words is one symbol, digits are another.
Texts are taken a few at a time, whose symbols are numbered anew, so that n-grams are places in a small
table; texts of very many different letters are sorted instead.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text
when there is nothing to learn from.  A null doc_id is not held out.  Rows that repeat are
predicted one by one; of equal scores the language first in order of names wins.  A text of any
length is read whole.  An empty table gives an empty result.  Columns other than doc_id, text and
lang are not read, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.llm.common import checkpoint
from storyloom.llm.ragged import column, pieces, row_of

PER_LANGUAGE = 200
LABELS = 20_000
SAMPLE = 2000
LANDMARKS = 300
RIDGE = 0.1
PIECE = 1 << 18
ROWS = 48
#: Places of a table of n-grams for some rows; rows of more are sorted.
PLACES = 1 << 25
#: Bits of a letter's code point (there are none beyond plane 3) in the number of an n-gram, which begins with its length.
BITS = 18
BETWEEN, DIGIT = 0, 1

_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point -> symbol: 0 between words, 1 for digits, else the lower-case letter's code point."""
    if not _fold:
        table = np.zeros(0x110000, np.int32)
        for point in range(0x110000):
            c = chr(point)
            kind = unicodedata.category(c)[0]
            if kind == "N":
                table[point] = DIGIT
            elif kind == "L":
                table[point] = ord(c.lower()[0])
        _fold.append(table)
    return _fold[0]


def number(symbols: list[np.ndarray]) -> np.ndarray:
    """The numbers of n-grams given by their symbols."""
    out = np.full(len(symbols[0]), len(symbols) - 1, np.int64)
    for s in symbols:
        out = out << BITS | s
    return out


class Grams:
    """Which n-grams stand in some texts: pairs of row and n-gram, and how many of each length a row has."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        self.rows = len(bounds) - 1
        owner = row_of(bounds)
        self.letters = np.zeros(self.rows, bool)
        self.letters[owner[symbols > DIGIT]] = True
        seen = np.zeros(0x110000, bool)
        seen[symbols] = True
        self.alphabet = np.flatnonzero(seen)
        m = max(1, len(self.alphabet))
        self.dense = self.rows * (m + m**2 + m**3) <= PLACES
        whole = [owner[: max(0, len(owner) - n)] == owner[n:] for n in range(3)]
        if self.dense:
            place = np.zeros(0x110000, np.int64)
            place[self.alphabet] = np.arange(len(self.alphabet))
            self.place, local, code = place, place[symbols], np.zeros(len(symbols), np.int64)
            self.flags = []
            for n in range(3):
                code = (code[:-1] if n else code) * m + local[n:]
                flags = np.zeros((self.rows, m ** (n + 1)), bool)
                flags[owner[: len(code)][whole[n]], code[whole[n]]] = True
                self.flags.append(flags)
            self.counts = np.stack([f.sum(axis=1) for f in self.flags], axis=1)
        else:
            pairs = []
            for n in range(3):
                code = number([symbols[k : len(symbols) - n + k][whole[n]] for k in range(n + 1)])
                pairs.append(np.stack([owner[: len(whole[n])][whole[n]], code], axis=1))
            order = np.concatenate(pairs)
            order = order[np.lexsort([order[:, 1], order[:, 0]])]
            new = np.ones(len(order), bool)
            new[1:] = (order[1:] != order[:-1]).any(axis=1)
            self.row, self.code = order[new].T
            self.counts = np.stack([np.bincount(self.row[self.code >> BITS * (n + 1) == n], minlength=self.rows) for n in range(3)], axis=1)

    def of(self, row: int) -> np.ndarray:
        """The numbers of a row's n-grams, ascending."""
        if not self.dense:
            return self.code[self.row == row]
        m, out = max(1, len(self.alphabet)), []
        for n, flags in enumerate(self.flags):
            code = np.flatnonzero(flags[row])
            out.append(number([self.alphabet[code // m ** (n - k) % m] for k in range(n + 1)]))
        return np.sort(np.concatenate(out))

    def product(self, codes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """The presence of these n-grams, each length scaled by how many the whole text has, times the matrix."""
        length = codes_length(codes)
        scale = 1 / np.sqrt(3 * np.maximum(self.counts, 1))
        out = np.zeros((self.rows, matrix.shape[1]))
        if self.dense:
            m = max(1, len(self.alphabet))
            known = np.zeros(0x110000, bool)
            known[self.alphabet] = True
            for n in range(3):
                some = np.flatnonzero(length == n)
                symbols = [codes[some] >> BITS * (n - k) & (1 << BITS) - 1 for k in range(n + 1)]
                there = np.logical_and.reduce([known[s] for s in symbols])
                place = np.zeros(int(there.sum()), np.int64)
                for s in symbols:
                    place = place * m + self.place[s[there]]
                out += (self.flags[n][:, place].astype(np.float32) @ matrix[some[there]]) * scale[:, n : n + 1]
            return out
        at = np.minimum(np.searchsorted(codes, self.code), len(codes) - 1)
        hit = codes[at] == self.code
        for n in range(3):
            use = np.flatnonzero(hit & (self.code >> BITS * (n + 1) == n))
            part = np.zeros((self.rows, matrix.shape[1]))
            np.add.at(part, self.row[use], matrix[at[use]])
            out += part * scale[:, n : n + 1]
        return out


def codes_length(codes: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for n-grams of one, two or three symbols."""
    return np.where(codes >> 3 * BITS == 2, 2, np.where(codes >> 2 * BITS == 1, 1, 0))


def presence(texts: pa.Array) -> Iterator[tuple[int, int, Grams]]:
    """(first row, end row, their n-grams), a few rows at a time."""
    fold = fold_table()
    for row, end, data, bounds in pieces(texts, PIECE):
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        symbols = fold[points].astype(np.int64)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
        for first in range(0, end - row, ROWS):
            upto = min(first + ROWS, end - row)
            yield row + first, row + upto, Grams(symbols[lead[first] : lead[upto]], lead[first : upto + 1] - lead[first])


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_sample(docs: DataFrame) -> DataFrame:
    """lang, text and place (in its language) of the rows to learn from."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = checkpoint(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    n = counts.count()
    if n > LABELS:
        raise ValueError(f"{n} languages; a classifier of {LABELS} outputs at most is fitted")
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, n)))
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    # Three times the rows that are wanted and some, in expectation; then the first of them.  Rare languages are taken whole.
    part = F.least(F.lit(1.0), (3 * each + 30) / F.col("n"))
    few = rows.join(F.broadcast(counts), "lang").where(F.pmod(order, F.lit(1 << 40)) < part * (1 << 40))
    few = few.select("lang", "text", F.col("doc_id").alias("id"), order.alias("rank"))
    return few.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("rank", "id", F.xxhash64("text")))).where(F.col("place") <= each)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, numbers of the n-grams, matrix), or None if there is nothing to learn from."""

    def features(batches):
        for batch in batches:
            for row, end, grams in presence(column(batch, "text")):
                raw = [grams.of(i).astype("<i8").tobytes() for i in range(end - row)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(2).slice(row, end - row), pa.array(raw, pa.binary())], ["lang", "place", "grams"])

    sample = training_sample(docs).select("lang", "text", "place").mapInArrow(features, "lang string, place int, grams binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r.place, r.lang))
    return solve([r.lang for r in sample], [np.frombuffer(r.grams, "<i8") for r in sample])


def solve(labels: list[str], grams: list[np.ndarray], landmarks: int = LANDMARKS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Ridge regression of each label against the others in the Nystroem map of the first texts, folded into one matrix over their n-grams."""
    languages = sorted(set(labels))
    marks = min(len(grams), max(landmarks, len(languages)))
    codes = np.unique(np.concatenate(grams[:marks]))

    def rows(some: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(some), len(codes)), np.float32)
        for i, g in enumerate(some):
            length = codes_length(g)
            counts = np.bincount(length, minlength=3)
            at = np.minimum(np.searchsorted(codes, g), len(codes) - 1)
            hit = codes[at] == g
            x[i, at[hit]] = 1 / np.sqrt(3 * counts[length[hit]])
        return x

    z = rows(grams[:marks])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    project = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([(rows(grams[a : a + 128]) @ z.T).astype(np.float64) @ project for a in range(0, len(grams), 128)])
    own = np.searchsorted(languages, labels)
    y = np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = (len(labels) / len(languages) / np.bincount(own, minlength=len(languages)))[own][:, None]
    w = np.linalg.solve(phi.T @ (phi * weight) + RIDGE * np.eye(phi.shape[1]), phi.T @ (y * weight))
    return languages, codes, (z.T @ (project @ w)).astype(np.float32)


def predict(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = fit(docs)
    kind = dict(docs.dtypes)["doc_id"]
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            names, scores = ["und"] * n, np.zeros(n)
            if told.value is not None:
                languages, codes, matrix = told.value
                for row, _, grams in presence(column(batch, "text")):
                    got = grams.product(codes, matrix)
                    best = got.argmax(axis=1)
                    for i in np.flatnonzero(grams.letters).tolist():
                        names[row + i] = languages[best[i]]
                        scores[row + i] = min(1.0, max(0.0, (float(got[i, best[i]]) + 1) / 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
