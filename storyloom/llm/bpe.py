"""Byte-level BPE: an exact backtracking encoder and a decoder from an offset table.

A word's tokens are found from left to right by longest Aho-Corasick matches.  A sequence of
tokens is the one that merging gives if and only if each neighbouring pair is compatible, that
is, merging the bytes of the pair alone leaves the pair.  Where a longest match does not fit
its left neighbour, the encoder tries shorter tokens and then steps back; places that are known
to lead nowhere are marked, so that each is tried once.

Every byte is a token, so that a search for longest matches never follows a failure link of the
automaton and needs its goto function alone.  That is one table of (node, byte), and what is
known of pairs is another; both answer whole arrays.  All short words of a batch take their
steps at the same time, one array operation for each; long ones go one by one.

Compatibility is read from the merges: two tokens are undone along their common border, latest
merge first, and fit if at no moment a merge over the border would have come first.

Each distinct word of a batch is encoded once.  Words are grouped by 64-bit hashes, and the bytes
of each are compared with those of its group, so that words that only hash alike stay apart.

A vocabulary must have every byte as a token, and merges in the order of training: one for each
token, after those of its parts.  Others are refused with a ValueError.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np

from storyloom.llm.ragged import expand, kept, prefix_sums, span_hashes

LETTER, NUMBER, OTHER, SPACE, SPECIAL = range(5)
#: The code points with the property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: The endings that the pattern of this vocabulary splits off.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Words of more bytes are encoded one by one.
SHORT = 48
#: Places of the table of pairs; a pair may take another's place.
PAIRS = 1 << 18
#: No letters or numbers beyond: the planes above 3 hold none.
PLANES = 0x40000


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    table[:PLANES] = [kinds.get(unicodedata.category(chr(point))[0], OTHER) for point in range(PLANES)]
    table[list(WHITE_SPACE)] = SPACE
    return table


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Open addressing from keys (distinct, below 2 ** 40) to numbers below 2 ** 22, for whole arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.entries = np.full(1 << bits, -1, np.int64)  # key and value in one number
        slot, entries = self._slot(keys), keys << 22 | values
        while len(entries):
            free = self.entries[slot] < 0
            self.entries[slot[free]] = entries[free]
            left = self.entries[slot] != entries
            entries, slot = entries[left], slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, -1 where there is none."""
        slot = self._slot(keys)
        found = self.entries[slot]
        out = np.where(found >> 22 == keys, found & 0x3FFFFF, -1)
        left = np.flatnonzero((out < 0) & (found >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            found = self.entries[slot[left]]
            hit = found >> 22 == keys[left]
            out[left[hit]] = found[hit] & 0x3FFFFF
            left = left[~hit & (found >= 0)]
        return out


class Vocabulary:
    """Tokens as bytes, merges, the automaton and the pair table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        names = {t["content"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in names}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        tokens = [b""] * self.size
        for token, i in [*self.ids.items(), *self.special.items()]:
            tokens[i] = token
        self.tokens = tokens
        self.lengths = [len(t) for t in tokens]
        self.token_length = np.array(self.lengths, np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_length)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._merges([[raw(x) for x in (m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]])
        self._automaton()

    def _merges(self, merges: list[list[bytes]]) -> None:
        """The merge that makes each token: its rank (-1 for a byte) and its two parts."""
        left, right, made = (np.array([self.ids[x] for x in column], np.int64) for column in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        self.rank = np.full(self.size, -1, np.int64)
        self.rank[made] = ranks = np.arange(len(merges))
        if len(np.unique(made)) < len(made) or (self.rank[left] >= ranks).any() or (self.rank[right] >= ranks).any():
            raise ValueError("merges are not in the order of training")
        if not all(bytes([b]) in self.ids for b in range(256)):
            raise ValueError("not every byte is a token")
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.left[made], self.right[made] = left, right
        self.merged = Table(left * self.size + right, ranks)
        self.known = np.full(PAIRS, -2, np.int64)  # 2 * pair + whether it fits
        # A token is the encoding of its own bytes if it is a byte, or its parts are and fit until their merge.
        self.whole = self.rank < 0
        self.whole[made] = self._undone(left, right, ranks, ranks)
        for i in made.tolist():
            self.whole[i] &= self.whole[self.left[i]] and self.whole[self.right[i]]

    def _automaton(self) -> None:
        """The goto function: (node, byte) to node. Nodes have a token or not; of tokens, the longest proper prefix is kept."""
        words = [(t, i) for t, i in self.ids.items() if self.whole[i]]
        ids, size = np.array([i for _, i in words]), np.array([len(t) for t, _ in words])
        width = int(size.max())
        letters = np.frombuffer(b"".join(t.ljust(width, b"\0") for t, _ in words), np.uint8).reshape(-1, width)
        node, above = np.zeros(len(words), np.int64), np.full(1, -1, np.int64)
        self.token = np.full(1, -1, np.int64)
        edges, children = [], []
        for depth in range(width):
            some = np.flatnonzero(size > depth)
            keys, place = np.unique(node[some] << 8 | letters[some, depth], return_inverse=True)
            first = len(self.token)
            node[some] = first + place
            parent = keys >> 8
            above = np.append(above, np.where(self.token[parent] >= 0, self.token[parent], above[parent]))
            self.token = np.append(self.token, np.full(len(keys), -1))
            ends = some[size[some] == depth + 1]
            self.token[node[ends]] = ids[ends]
            edges.append(keys)
            children.append(first + np.arange(len(keys)))
        self.goto = Table(np.concatenate(edges), np.concatenate(children))
        self.root = self.goto.get(np.arange(256))
        self.shorter = np.full(self.size, -1, np.int64)
        self.shorter[ids] = above[node]
        self.automaton = ahocorasick.Automaton()
        for token, i in words:
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.longest_token = width

    def _undone(self, left: np.ndarray, right: np.ndarray, before_left: np.ndarray, before_right: np.ndarray) -> np.ndarray:
        """Whether no merge over the border comes before the merges (ranks) that are to take left and right next; of equal ranks the left one goes first."""
        fit = np.ones(len(left), bool)
        at = np.arange(len(left))
        a, b, before_a, before_b = left, right, before_left, before_right
        while len(at):
            over = self.merged.get(a * self.size + b)
            spoils = (over >= 0) & (over < before_a) & (over <= before_b)
            fit[at[spoils]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            of_left = rank_a > rank_b
            before_a, before_b = np.where(of_left, rank_a, before_a), np.where(of_left, before_b, rank_b)
            a, b = np.where(of_left, self.right[a], a), np.where(of_left, b, self.left[b])
            go = ~spoils & ((rank_a >= 0) | (rank_b >= 0))
            at, a, b, before_a, before_b = (x[go] for x in (at, a, b, before_a, before_b))
        return fit

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pairs of tokens are compatible."""
        pair = left * self.size + right
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & PAIRS - 1
        known = self.known[slot]
        new = np.flatnonzero(known >> 1 != pair)
        if len(new):
            never = np.full(len(new), 1 << 62)
            known[new] = self.known[slot[new]] = 2 * pair[new] + self._undone(left[new], right[new], never, never)
        return (known & 1).astype(bool)

    def compatible(self, left: int, right: int) -> bool:
        return bool(self.fits(np.array([left]), np.array([right]))[0])

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token that stands at each place, before its end."""
        node = self.root[data[at]]
        best = self.token[node]
        who = np.flatnonzero(at + 1 < end)
        place, node = at[who] + 1, node[who]
        while len(who):
            node = self.goto.get(node << 8 | data[place])
            more = np.flatnonzero(node >= 0)
            who, place, node = who[more], place[more] + 1, node[more]
            token = self.token[node]
            named = np.flatnonzero(token >= 0)
            best[who[named]] = token[named]
            more = np.flatnonzero(place < end[who])
            who, place, node = who[more], place[more], node[more]
        return best

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word)."""
        size = ends - starts
        base = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int64)  # a word's tokens stand from its base on
        depth = np.zeros(len(starts), np.int64)
        for k in np.flatnonzero(size > SHORT).tolist():
            ids = self.encode_word(data[starts[k] : ends[k]].tobytes())
            out[base[k] : base[k] + len(ids)] = ids
            depth[k] = len(ids)
        dead = np.zeros(len(out) + 1, bool)
        who = np.flatnonzero(size <= SHORT)
        at, end, shift = starts[who], ends[who], (base - starts)[who]
        token = self.longest(data, at, end)
        while len(who):
            has = token >= 0
            stop = at + self.token_length[token]
            ok = has & ~dead[np.where(has, stop + shift, 0)]
            top = base[who] + depth[who]
            second = np.flatnonzero(ok & (depth[who] > 0))
            ok[second] = self.fits(out[top[second] - 1], token[second])
            out[top[ok]] = token[ok]
            depth[who[ok]] += 1
            at = np.where(ok, stop, at)
            # Where no token fits, take back the last one and go on with a shorter one in its place.
            back = np.flatnonzero(~has)
            if len(back):
                dead[at[back] + shift[back]] = True
                token[back] = out[top[back] - 1]
                depth[who[back]] -= 1
                at[back] -= self.token_length[token[back]]
            token = np.where(ok, token, self.shorter[token])
            left = ~ok | (at < end)
            if not left.all():
                who, at, end, shift, token, ok = (x[left] for x in (who, at, end, shift, token, ok))
            go = np.flatnonzero(ok)
            token[go] = self.longest(data, at[go], end[go])
        return out[expand(base, depth)], depth

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word, of any length."""
        text = word.decode("latin-1")
        tokens = [i for _, i in self.automaton.iter_long(text)]
        pairs = np.array(tokens, np.int64)
        wrong = np.flatnonzero(~self.fits(pairs[:-1], pairs[1:]))
        return self.backtrack(text, tokens[: int(wrong[0]) + 1]) if len(wrong) else tokens

    def backtrack(self, text: str, out: list[int]) -> list[int]:
        """The ids of a word whose first ids are known."""
        lengths, shorter, reach, n = self.lengths, self.shorter, self.longest_token, len(text)
        at, dead, seen = sum(lengths[i] for i in out), set(), {}
        while at < n:
            token = next(self.automaton.iter_long(text[at : at + reach]))[1]
            while True:
                if token < 0:  # no token fits here: take back the last one and go on with a shorter one in its place
                    dead.add(at)
                    token = out.pop()
                    at -= lengths[token]
                elif at + lengths[token] not in dead:
                    pair = (out[-1], token) if out else None
                    fit = seen.get(pair) if out else True
                    if fit is None:
                        fit = seen[pair] = self.compatible(*pair)
                    if fit:
                        break
                token = int(shorter[token])
            out.append(token)
            at += lengths[token]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, gathered from one table of all tokens by its offsets."""
        return self.token_bytes[expand(self.token_start[ids], self.token_length[ids])]


class Encoder:
    """Ids of whole batches of texts."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.classes = _classes()

    def byte_classes(self, data: np.ndarray) -> np.ndarray:
        """The class of the character that each byte belongs to."""
        kinds = self.classes[data]  # right for ASCII
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
            first = padded[lead]
            width = 2 + (first >= 0xE0) + (first >= 0xF0)
            one, two, three = (padded[lead + k] & 0x3F for k in (1, 2, 3))
            point = np.where(width == 2, (first & 0x1F) << 6 | one, np.where(width == 3, (first & 0x0F) << 12 | one << 6 | two, (first & 0x07) << 18 | one << 12 | two << 6 | three))
            kind = self.classes[np.minimum(point, 0x10FFFF)]
            kinds[lead] = kind
            for k in (1, 2, 3):
                at = width > k
                kinds[lead[at] + k] = kind[at]
        return kinds

    def word_starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the words of the vocabulary's pattern start."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kinds = self.byte_classes(data)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        for name in self.vocabulary.special:
            raw, at = data.tobytes(), -1
            while (at := raw.find(name, at + 1)) >= 0:
                if not edge[at + 1 : at + len(name)].any():
                    edge[at] = edge[at + len(name)] = True
                    kinds[at : at + len(name)] = SPECIAL
        change = edge[:n].copy()
        change[1:] |= kinds[1:] != kinds[:-1]
        begin = np.flatnonzero(change)
        end = np.append(begin[1:], n)
        kind, closing = kinds[begin], edge[end]
        starts = np.zeros(n + 1, bool)
        starts[begin] = True
        open_space = np.flatnonzero((kind == SPACE) & ~closing)
        last = end[open_space] - 1  # the start of a run's last character
        for _ in range(3):
            last -= (data[last] & 0xC0) == 0x80
        starts[last] = True
        joins = data[last] == 0x20
        starts[end[open_space[joins]]] = False
        quote = np.flatnonzero((kind == OTHER) & (end - begin == 1) & ~closing & (data[begin] == 0x27) & starts[begin])
        quote = quote[kind[quote + 1] == LETTER] if len(quote) else quote
        for run in quote:
            letters = data[begin[run + 1] : min(end[run + 1], begin[run + 1] + 2)].tobytes()
            tail = next((c for c in CONTRACTIONS if letters.startswith(c)), None)
            if tail:
                starts[begin[run + 1]] = False
                starts[begin[run + 1] + len(tail)] = True
        return np.flatnonzero(starts[:n])

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each row's ids)."""
        starts = self.word_starts(data, bounds)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        ends = np.append(starts[1:], len(data))
        first, place = distinct(data, starts, ends)
        known, counts = self.vocabulary.encode_words(data, starts[first], ends[first])
        where = np.cumsum(counts) - counts
        known = known.astype(np.int32)
        for name, i in self.vocabulary.special.items():
            if data.tobytes().find(name) >= 0:
                size = ends[first] - starts[first]
                for k in np.flatnonzero(size == len(name)).tolist():
                    if data[starts[first[k]] : ends[first[k]]].tobytes() == name:
                        known[where[k]], counts[k] = i, 1
        counts = counts[place]
        ids = known[expand(where[place], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(starts, bounds)]

    def batches(self, texts, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, bounds) of an Arrow column, piece by piece."""
        from storyloom.llm.ragged import pieces

        for row, end, data, bounds in pieces(texts, size):
            yield row, end, *self.encode(data, bounds)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each kind of words, kind of each word). The words follow each other without gaps."""
    size = ends - starts
    _, first, place = np.unique(span_hashes(prefix_sums(data), starts, ends), return_index=True, return_inverse=True)
    model = first[place]
    model = np.where(size[model] == size, model, np.arange(len(size)))
    wrong = np.flatnonzero(data[starts[0] : ends[-1]] != data[expand(starts[model], size)]) + starts[0]
    apart = np.unique(np.concatenate([np.searchsorted(starts, wrong, "right") - 1, np.flatnonzero(model != first[place])]))
    if len(apart):  # they only hash like the first of their kind
        place[apart] = len(first) + np.arange(len(apart))
        first = np.concatenate([first, apart])
    return first, place


_encoders: dict[str, Encoder] = {}
kept.append(_encoders)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
