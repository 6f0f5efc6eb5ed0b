"""First values of clusters, indexed so that a new value meets only those that may be similar to it.

Each kind has find(value), the order of the first leader that is similar enough (or None), and add(value, order). Leaders are added in
their order. Every index finds what a walk over all leaders would.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from itertools import chain

import numpy as np

from traceaudit.functions.similarity import SIMILARITIES, TOLERANCE, set_similarity, tokens_of

#: Leaders that a new vector meets in one product.
CHUNK = 512


class Walk:
    """Any similarity of (leader, value): all leaders in turn."""

    def __init__(self, similarity, least: float):
        self.similarity, self.least, self.leaders = similarity, least, []

    def find(self, value):
        return next((order for leader, order in self.leaders if self.similarity(leader, value) >= self.least), None)

    def add(self, value, order) -> None:
        self.leaders.append((value, order))


class Sizes:
    """Jaccard of sets: leaders by size. Two sets of sizes a <= b have at most a / b, so only sizes from least * n to n / least are met, and of each the leaders before the best hit so far."""

    def __init__(self, members, least: float):
        self.members, self.least, self.buckets = members, least, {}

    def find(self, value):
        mine, best = self.members(value), None
        n = len(mine)
        if not n:
            return None
        if self.least <= 0:
            sizes = list(self.buckets)
        else:
            sizes = [m for m in range(max(1, math.floor(self.least * n)), math.ceil(n / self.least) + 1) if m in self.buckets]
        for m in sizes:
            for leader, order in self.buckets[m]:
                if best is not None and order >= best:
                    break
                both = len(mine & leader)
                if both / (n + m - both) >= self.least:
                    best = order
                    break
        return best

    def add(self, value, order) -> None:
        mine = self.members(value)
        if mine:
            self.buckets.setdefault(len(mine), []).append((mine, order))


class Words:
    """Jaccard of sets of words: leaders by their rare words.

    Of two sets of n and m words that are similar enough, each has at least `least` of its words in the other, so under any one order of words they share one of the
    first n - ceil(least * n) + 1 of the one and the first m - ceil(least * m) + 1 of the other. The order is by the number of leaders that had a word when
    they last doubled, rare words first; all leaders are filed anew then. A word that no leader has comes before all others and needs no looking up.
    """

    def __init__(self, members, least: float):
        self.members, self.least = members, least
        self.ids, self.places, self.leaders, self.filed, self.due = {}, [], [], {}, 16

    def firsts(self, known, n: int, unknown: int = 0) -> list[int]:
        """Of the ids of a set of n words, those that have to be looked up."""
        most = n - max(1, math.ceil(self.least * n - 1e-9)) + 1 - unknown  # less by what a division may round
        return sorted(known, key=self.places.__getitem__)[:most] if most > 0 else []

    def find(self, value):
        words, best, met = self.members(value), len(self.leaders), set()
        n = len(words)
        if self.least <= 0 and n and best:
            return self.leaders[0][1]
        mine = {self.ids[w] for w in words if w in self.ids}
        for i in self.firsts(mine, n, n - len(mine)) if n else ():
            for at in self.filed.get(i, ()):
                if at >= best:
                    break
                if at not in met:
                    met.add(at)
                    if self.similar(mine, n, self.leaders[at][0]):
                        best = at
                        break
        return self.leaders[best][1] if best < len(self.leaders) else None

    def similar(self, mine: set[int], n: int, leader) -> bool:
        m = len(leader)
        if min(n, m) < (self.least - 1e-9) * max(n, m):
            return False
        both = len(mine.intersection(leader))
        return both / (n + m - both) >= self.least

    def add(self, value, order) -> None:
        words = self.members(value)
        if not words:
            return
        mine = array("i", [self.ids.setdefault(w, len(self.ids)) for w in words])
        self.places.extend(range(len(self.places), len(self.ids)))
        self.leaders.append((mine, order))
        if len(self.leaders) < self.due:
            self.file(len(self.leaders) - 1)
            return
        self.due, self.filed = 2 * self.due, {}
        for i, count in Counter(chain.from_iterable(leader for leader, _ in self.leaders)).items():
            self.places[i] = (count << 32) + i
        for at in range(len(self.leaders)):
            self.file(at)

    def file(self, at: int) -> None:
        leader = self.leaders[at][0]
        for i in self.firsts(leader, len(leader)):
            self.filed.setdefault(i, []).append(at)


class Numbers:
    """Numbers within a tolerance: leaders by bins as wide as the largest distance that still counts."""

    def __init__(self, least: float):
        self.least, self.width, self.bins = least, max(TOLERANCE * (1 - least), 1e-12), {}

    def find(self, value):
        x = float(value)
        if not math.isfinite(x):
            return None
        at = math.floor(x / self.width)
        similar = SIMILARITIES["numeric"][0]
        return min((order for b in (at - 1, at, at + 1) for leader, order in self.bins.get(b, ()) if similar(leader, x) >= self.least), default=None)

    def add(self, value, order) -> None:
        x = float(value)
        if math.isfinite(x):
            self.bins.setdefault(math.floor(x / self.width), []).append((x, order))


class Parts:
    """Sets of structures: the mean over a leader's parts of the best Tanimoto among the value's parts, 1 for the same multiset of canonical forms.

    Leaders of equal multisets are looked up; for the others the mean has a bound from the sizes of the parts alone, and only leaders whose bound reaches the threshold are compared.
    """

    def __init__(self, least: float):
        self.least, self.leaders, self.equal = least, [], {}

    @staticmethod
    def canonical(value) -> tuple:
        return tuple(sorted(p["canonical"] or "" for p in value))

    def find(self, value):
        best = self.equal.get(self.canonical(value))
        sizes = sorted({len(p["bits"]) for p in value if p["bits"]})
        for leader, own, order in self.leaders:
            if best is not None and order >= best:
                break
            bound = sum(max((min(n, m) / max(n, m) for m in sizes), default=0.0) for n in own if n)
            if bound >= self.least * max(1, len(own)) and set_similarity(leader, value) >= self.least:
                return order
        return best

    def add(self, value, order) -> None:
        self.equal.setdefault(self.canonical(value), order)
        self.leaders.append((value, [len(p["bits"] or ()) for p in value], order))


class Vectors:
    """Cosine: unit vectors in one growing matrix for each dimension, met chunk by chunk up to the first hit."""

    def __init__(self, least: float):
        self.least, self.rows = least, {}

    @staticmethod
    def unit(value) -> np.ndarray | None:
        v = np.array([np.nan if x is None else x for x in value], np.float64)
        norm = np.sqrt((v * v).sum())
        return v / norm if np.isfinite(norm) and norm > 0 else None

    def find(self, value):
        v = self.unit(value)
        matrix, n, orders = self.rows.get(len(value), (None, 0, ()))
        for at in range(0, n if v is not None else 0, CHUNK):
            hits = np.flatnonzero((matrix[at : min(n, at + CHUNK)] * v).sum(axis=1) >= self.least)
            if len(hits):
                return orders[at + int(hits[0])]
        return None

    def add(self, value, order) -> None:
        v = self.unit(value)
        if v is None:
            return
        matrix, n, orders = self.rows.get(len(v), (np.empty((16, len(v))), 0, []))
        if n == len(matrix):
            matrix = np.concatenate([matrix, np.empty_like(matrix)])
        matrix[n] = v
        orders.append(order)
        self.rows[len(v)] = (matrix, n + 1, orders)


def leaders_of(kind: str, similarity, least: float):
    """An empty index for a kind, or for a similarity function of its own."""
    if similarity is not None:
        return Walk(similarity, least)
    if kind in ("text", "reasoning"):
        return Words(tokens_of, least)
    if kind == "structure":
        return Sizes(frozenset, least)
    return {"numeric": Numbers, "set": Parts, "embedding": Vectors}[kind](least) if kind != "label" else Walk(SIMILARITIES["label"][0], least)
