"""Linking against a plain version of its rules, over invented titles."""

import datetime as dt
import math
import random
import re
from itertools import combinations

import pytest

from storyloom import config
from storyloom.operators import linking


def stem(w):
    if len(w) <= 3:
        return w
    undouble = lambda s: s[:-1] if re.search(r"([bcdfghjkmnpqrtvwxy])\1$", s) else s
    if w.endswith("ies") and len(w) >= 5:
        w = w[:-3] + "y"
    elif w.endswith("sses"):
        w = w[:-2]
    elif not w.endswith(("ss", "us", "is")) and w.endswith("s"):
        w = w[:-1]
    if w.endswith("ing") and len(w) >= 6:
        w = undouble(w[:-3])
    elif w.endswith("ied") and len(w) >= 5:
        w = w[:-3] + "y"
    elif w.endswith("ed") and len(w) >= 5:
        w = undouble(w[:-2])
    if w.endswith("ly") and len(w) >= 6:
        w = w[:-2]
    return w[:-1] if w.endswith("e") and len(w) >= 4 else w


def tokens(title):
    return [w for w in re.split("[^a-z0-9]+", re.sub("['’]", "", title.lower())) if len(w) > 1 and w not in config.STOPWORDS]


VERBS = {v: g for g, vs in config.ACTIONS.items() for v in vs}


class Row:
    def __init__(self, ord_, title, domain, category, entities, at):
        self.ord, self.title, self.domain, self.category, self.entities, self.at = ord_, title, domain, category, entities, at
        words = tokens(title)
        self.tokens, self.bigrams, self.names = set(words), {" ".join(p) for p in zip(words, words[1:])}, {e.lower() for e in entities}
        self.stems = {stem(w) for w in words}
        match = re.sub(r"(?i)\bpassed\s+away\b", "died", re.sub(r"(?i)\bpasses\s+away\b", "dies", title))
        every = {stem(w) for w in tokens(match)}
        self.actions = {VERBS[s] for s in every if s in VERBS}
        self.plain = {s for s in every if s not in VERBS and s not in config.WEAK_STEMS}
        self.terms = self.plain | {f"act:{a}" for a in self.actions}
        raw = re.split(r"\s+", match)
        self.proper = {stem(t) for w in raw[1:] if re.match("[A-Z]", w) for t in tokens(w)} | {stem(t) for e in entities for t in tokens(e)}
        self.proper &= self.plain
        self.pairs = set()
        for x, y in [(tokens(x), tokens(y)) for x, y in zip(raw, raw[1:]) if re.match("[A-Z]", x) and re.match("[A-Z]", y)] + [([t[0]], [t[1]]) for t in map(tokens, entities) if len(t) == 2]:
            if len(x) == len(y) == 1 and {stem(x[0]), stem(y[0])} <= self.plain:
                self.pairs.add((stem(x[0]), stem(y[0])))
        self.death = bool(re.search(config.DEATH, title))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


class Rules:
    def __init__(self, rows):
        self.rows = rows
        self.df = {}
        for r in rows:
            for t in r.terms:
                self.df[t] = self.df.get(t, 0) + 1
        self.limit = max(config.RARE_FLOOR, math.ceil(len(rows) * config.RARE_SHARE))

    def weight(self, terms):
        return sum(math.log(1 + len(self.rows) / self.df[t]) for t in sorted(terms))

    def headline(self, a, b):
        return 0.5 * jaccard(a.tokens, b.tokens) + 0.3 * jaccard(a.bigrams, b.bigrams) + 0.2 * jaccard(a.names, b.names)

    def rare(self, a, b):
        return {s for s in a.plain & b.plain if self.df[s] <= self.limit}

    def conflict(self, x, y):
        return bool(x and y and not x & y)

    def strong(self, a, b):
        rare = self.rare(a, b)
        return len(rare) >= 2 and bool(rare & (a.proper | b.proper)) and not self.conflict(a.actions, b.actions)

    def close(self, a, b):
        return abs((a.at - b.at).total_seconds()) <= config.PAIR_HOURS * 3600

    def died(self, a, b):
        if not (a.death and b.death and self.close(a, b)) or self.conflict(a.actions - {"death"}, b.actions - {"death"}):
            return False
        rare = self.rare(a, b)
        return len(rare & (a.proper | b.proper)) >= 2 or any(set(p) <= rare for p in a.pairs & b.pairs)

    def evident(self, a, b):
        both, wa, wb = self.weight(a.terms & b.terms), self.weight(a.terms), self.weight(b.terms)
        bar = 0.72 if not a.actions & b.actions else 0.62 if len(self.rare(a, b)) >= 3 else 0.65
        return self.strong(a, b) and (both / (wa + wb - both) >= config.PRINT_FLOOR or both / min(wa, wb) >= bar)

    def link(self, a, b):
        if a.domain == b.domain or not self.close(a, b):
            return False
        h = self.headline(a, b)
        floor = config.PAIR_FLOOR + config.CROSS_CATEGORY * (a.category != b.category) + config.CONFLICT * self.conflict(a.actions, b.actions)
        return h >= floor or h >= config.HEADLINE_FLOOR and (self.evident(a, b) or self.died(a, b))

    def supports(self, a, b):
        return self.headline(a, b) >= config.LEAD_FLOOR or self.died(a, b) or self.evident(a, b)

    def candidates(self):
        posts, found = {}, {}
        for kind, weight in (("tokens", 1), ("stems", 1), ("names", 2)):
            for r in self.rows:
                for v in getattr(r, kind):
                    posts.setdefault((kind, v, weight), []).append(r)
        for (_, _, weight), some in posts.items():
            if len(some) <= config.POSTING_CUTOFF:
                for a, b in combinations(some, 2):
                    found[a.ord, b.ord] = found.get((a.ord, b.ord), 0) + weight
        return [p for p, n in found.items() if n >= 2]

    def validated(self, groups):
        out = []
        for group in groups:
            lead = min(group, key=lambda r: (-(1 + bool(r.entities)), -r.at.timestamp(), r.ord))
            kept = [r for r in group if r is lead or self.supports(r, lead) or 2 * sum(self.supports(r, o) for o in group if o is not r and o is not lead) > len(group) - 1]
            out += [kept] + [[r] for r in group if r not in kept]
        return out

    def merged(self, groups):
        prints = []
        for g in groups:
            count = {}
            for r in g:
                for s in r.plain:
                    count[s] = count.get(s, 0) + 1
            top = sorted(count, key=lambda s: (-count[s], -self.weight({s}), s))[:10]
            prints.append((set(top), set().union(*(r.proper for r in g)), set().union(*(r.actions for r in g)), min(r.at for r in g), max(r.at for r in g)))
        edges = []
        window = dt.timedelta(hours=config.PAIR_HOURS)
        for (i, a), (j, b) in combinations(enumerate(prints), 2):
            shared = a[0] & b[0]
            rare = {s for s in shared if self.df[s] <= self.limit}
            if a[3] <= b[4] + window and b[3] <= a[4] + window and not self.conflict(a[2], b[2]) and len(rare) >= 2 and rare & (a[1] | b[1]):
                if self.weight(shared) / min(self.weight(a[0]), self.weight(b[0])) >= config.GROUP_OVERLAP:
                    edges.append((i, j))
        return joined(groups, edges)

    def clusters(self):
        by = {r.ord: r for r in self.rows}
        place = {r.ord: i for i, r in enumerate(self.rows)}
        groups = joined([[r] for r in self.rows], [(place[a], place[b]) for a, b in self.candidates() if self.link(by[a], by[b])])
        return {frozenset(r.ord for r in g) for g in self.validated(self.merged(self.validated(groups)))}


def joined(groups, edges):
    label = list(range(len(groups)))
    for _ in groups:
        before = list(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    out = {}
    for i, g in enumerate(groups):
        out.setdefault(label[i], []).extend(g)
    return list(out.values())


FIRST, LAST = "Anna Boris Carla Dmitri Elena Farid Greta Hugo".split(), "Kowal Lindqvist Marsh Novak Okafor Petrov Quist Rossi".split()
PLACES = "Harborview Lakeside Merrin Northgate Oakridge Pinefield Quarry Riverton".split()
THINGS = "bridge ferry museum reactor tunnel orchestra vaccine satellite harvest pipeline".split()


def titles(seed, n=140):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        name, place, thing, other = f"{rng.choice(FIRST)} {rng.choice(LAST)}", rng.choice(PLACES), rng.choice(THINGS), rng.choice(THINGS)
        verb = rng.choice(["wins", "launches", "cuts", "unveils", "slashes", "detained", "charged"])
        forms = [
            f"{name} dies at {rng.randint(60, 90)} in {place}", f"Obituary: {name} of {place} remembered for {thing}", f"{name} passes away after {thing} accident",
            f"{name} {verb} {thing} contract in {place}", f"{place} {thing}: {name} {verb} big contract", f"Officials say {name} {verb} the {thing}", f"{place} {thing} closed after {other} fire",
            f"Fire at {other} forces {place} {thing} closure", f"{other} fire: {place} shuts {thing}, residents told", f"Monday storm hits {place} {thing} and {other}", f"Storm damages {thing} near {place}", "",
        ]
        base = dt.datetime(2024, 1, 20) + dt.timedelta(hours=rng.randrange(0, 160))
        for title in rng.sample(forms, rng.randint(1, 6)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                entities = rng.choice([[], [name], [place], [name, place]]) if title else []
                out.append((title, f"{rng.choice('abcdefgh')}.x", rng.choice(["world", "business"]), entities, base + dt.timedelta(minutes=rng.randrange(0, 4000))))
    return out[:n]


SCHEMA = "ord long, title string, domain string, source string, tier string, category string, country string, content_type string, description string, canonical_url string, id string, entities array<string>, published_at timestamp"


def table(spark, rows):
    return spark.createDataFrame([(i, t, d, d, "B", c, "US", "news", "text", f"https://{d}/{i}", str(i), e, at) for i, (t, d, c, e, at) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_features_and_decisions(spark, seed):
    rows = titles(seed, 60)
    plain = [Row(i, *r) for i, r in enumerate(rows)]
    got = {r.ord: r for r in linking.features(table(spark, rows)).collect()}
    for r in plain:
        g = got[r.ord]
        for name in ("tokens", "bigrams", "names", "stems", "actions", "plain", "terms", "proper"):
            assert set(g[name]) == getattr(r, name), (name, r.title)
        assert {tuple(p.split(" ")) for p in g["pairs"]} == r.pairs and g["death"] == r.death
    rules = Rules(plain)
    pairs = spark.createDataFrame([(a.ord, b.ord) for a, b in combinations(plain, 2)], "a long, b long")
    features = linking.features(table(spark, rows))
    for d in linking.decide(pairs, features).collect():
        a, b = plain[d.a], plain[d.b]
        assert d.headline == pytest.approx(rules.headline(a, b)) and d.rare == len(rules.rare(a, b))
        assert (d.link, d.supports, d.strong, d.died, d.conflict) == (rules.link(a, b), rules.supports(a, b), rules.strong(a, b), rules.died(a, b), rules.conflict(a.actions, b.actions)), (a.title, b.title)


@pytest.mark.parametrize("seed", [3, 4])
def test_clusters_as_the_rules_say(spark, seed):
    rows = titles(seed)
    want = Rules([Row(i, *r) for i, r in enumerate(rows)]).clusters()
    found = {}
    for r in linking.cluster(table(spark, rows)).select("ord", "grp").collect():
        found.setdefault(r.grp, set()).add(r.ord)
    assert {frozenset(g) for g in found.values()} == want
    assert sum(len(g) > 1 for g in want) >= 10


def test_second_pass_as_the_rules_say(spark):
    rows = titles(5, 120)
    plain = [Row(i, *r) for i, r in enumerate(rows)]
    groups = {}
    for r in plain:
        groups.setdefault(r.ord - r.ord % 2, []).append(r)
    want = {frozenset(r.ord for r in g) for g in Rules(plain).merged(list(groups.values()))}
    start = linking.weighing(linking.features(table(spark, rows))).withColumn("grp", linking.F.col("ord") - linking.F.col("ord") % 2)
    found = {}
    for r in linking.second_pass(start).select("ord", "grp").collect():
        found.setdefault(r.grp, set()).add(r.ord)
    assert {frozenset(g) for g in found.values()} == want and len(want) < len(groups)


class Whole(Rules):
    """The rules over all pairs, without a cutoff of postings."""

    def candidates(self):
        return [(a.ord, b.ord) for a, b in combinations(self.rows, 2)]


def copied(seed, n=170):
    """titles() and many copies of six of them over a week, in two domains, so that words are in more than 50 titles."""
    rows, rng = titles(seed, n), random.Random(seed)
    for title, _, _, entities, at in [rng.choice(rows) for _ in range(6)]:
        for _ in range(rng.choice([20, 60])):
            rows.append((title, f"{rng.choice('ab')}.x", rng.choice(["world", "business"]), entities, at + dt.timedelta(hours=rng.randrange(-90, 90))))
    return rows


@pytest.mark.parametrize("seed, stems, names", [(12, 256, 16), (14, 2, 0)])
def test_links_look_at_postings_of_any_length(spark, monkeypatch, seed, stems, names):
    """Groups and links are those of all pairs, also for titles of more stems and names than keys go by pairs."""
    monkeypatch.setattr(linking, "_STEMS", stems)
    monkeypatch.setattr(linking, "_NAMES", names)
    rows = copied(seed)
    plain = [Row(i, *r) for i, r in enumerate(rows)]
    rules, alone = Whole(plain), [[i] for i in range(len(rows))]
    parts = lambda edges: {frozenset(g) for g in joined(alone, edges)}
    whole = [(a.ord, b.ord) for a, b in combinations(plain, 2) if rules.link(a, b)]
    got = {(r.a, r.b) for r in linking.links(linking.weighing(linking.features(table(spark, rows)))).collect()}
    assert parts(list(got)) == parts(whole) != parts([p for p in Rules(plain).candidates() if rules.link(plain[p[0]], plain[p[1]])])
    assert len(got) < len(whole)  # copies link in a line, not each with each
    found = {}
    for r in linking.cluster(table(spark, rows)).select("ord", "grp").collect():
        found.setdefault(r.grp, set()).add(r.ord)
    assert {frozenset(g) for g in found.values()} == rules.clusters()


def test_a_member_that_goes_takes_no_group_with_its_name(spark):
    """The least member names its group; where it goes, the others are named by the least that stays."""
    base = dt.datetime(2024, 1, 20)
    rows = [("Merrin tunnel shut again", "a.x", "world", [], base)] + [("Anna Kowal unveils ferry", f"{d}.x", "world", [], base + dt.timedelta(minutes=d)) for d in (1, 2, 3)]
    start = linking.weighing(linking.features(table(spark, rows))).withColumn("grp", linking.F.lit(0).cast("long"))
    assert {r.ord: r.grp for r in linking.validated(start).select("ord", "grp").collect()} == {0: 0, 1: 1, 2: 1, 3: 1}  # all 0 before
