"""Similarities of values, token sets, fingerprints and texts."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.text import once, strip, tokenize
from traceaudit.session import cut


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b)).cast("double")).otherwise(F.lit(0.0))


def token_jaccard(a: Column, b: Column, mode: str = "alnum") -> Column:
    return set_jaccard(tokenize(a, mode), tokenize(b, mode))


def tanimoto(a: Column, b: Column) -> Column:
    """Of two arrays of on-bits; null if either is null, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union), F.lit(0.0)))


def on_bits(v: Column) -> Column:
    """Positions (from 0) of the positive components."""
    return F.filter(F.transform(v, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def numeric_similarity(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / tolerance)


def label_match(a: Column, b: Column) -> Column:
    return F.when(strip(F.lower(a)) == strip(F.lower(b)), 1).otherwise(0)


def best_match(left: Column, right: Column) -> Column:
    """Mean over the left sets of the best set Jaccard on the right; 1 for equal multisets, 0 if either side is empty. left, right: arrays of token arrays."""
    best = F.transform(left, lambda a: F.coalesce(F.array_max(F.transform(right, lambda b: set_jaccard(a, b))), F.lit(0.0)))
    mean = F.try_divide(F.aggregate(best, F.lit(0.0), lambda s, x: s + x), F.size(left))
    return F.when(F.sort_array(left) == F.sort_array(right), F.lit(1.0)).otherwise(F.coalesce(mean, F.lit(0.0)))


def property_bucket(weight: Column, rings: Column, limit: float, most_rings: int, rotatable: Column | None = None, most_rotatable: int = 3, carbons: Column | None = None, most_carbons: int = 20) -> Column:
    """heavy or light, and complex (too many rings, rotatable bonds or carbons, of those that are given) or simple, as `heavy/complex`; nulls exceed nothing."""
    over = [F.coalesce(x > most, F.lit(False)) for x, most in ((rings, most_rings), (rotatable, most_rotatable), (carbons, most_carbons)) if x is not None]
    complex_ = over[0]
    for o in over[1:]:
        complex_ = complex_ | o
    return F.concat_ws("/", F.when(weight > limit, "heavy").otherwise("light"), F.when(complex_, "complex").otherwise("simple"))


#: Fingerprints of a block, and blocks of a group.
FINGERPRINTS, GROUP = 1024, 32


def fingerprint_blocks(df: DataFrame, rows: int, ids: bool) -> DataFrame:
    """Blocks of at most `rows` fingerprints of neighbouring numbers of bits, from df(id, bits): (block, least, most, n, ids, bits), least and most over its numbers of bits.

    Rows are ranged by their number of bits before they are packed, so that blocks are narrow in it (and by chance among equal numbers, which changes what shares a block and no result). bits: row and place of each set bit as int32 pairs.
    """

    def pack(batches):
        held = []

        def out():
            sizes = [len(b) for _, b in held]
            at = np.concatenate([np.stack([np.full(len(b), i, np.int32), np.asarray(b, np.int32)], 1) for i, (_, b) in enumerate(held)]) if held else np.empty((0, 2), np.int32)
            columns = [[uuid.uuid4().int >> 65], [min(sizes)], [max(sizes)], [len(held)], [[i for i, _ in held]], [at.astype(np.int32).tobytes()]]
            held.clear()
            return pd.DataFrame(dict(zip(("block", "least", "most", "n", "ids", "bits"), columns, strict=True)))

        for frame in batches:
            for i, bits in zip(frame["id"], frame["bits"], strict=True):
                held.append((i, bits))
                if len(held) == rows:
                    yield out()
        if held:
            yield out()

    one = df.select("id" if ids else F.lit(0).alias("id"), F.array_distinct("bits").alias("bits")).filter("bits IS NOT NULL")
    ranged = one.repartitionByRange(F.size("bits"), F.rand(7)).sortWithinPartitions(F.size("bits"))
    return cut(ranged.mapInPandas(pack, f"block long, least int, most int, n int, ids array<{one.schema['id'].dataType.simpleString()}>, bits binary"), "novelty-blocks")


def novelty(new: DataFrame, known: DataFrame, rows: int = FINGERPRINTS, group: int = GROUP) -> DataFrame:
    """(id, novelty): 1 less the largest Tanimoto of new(id, bits) to known(bits), arrays of on-bits below 2^16; 1 without known items, without bits and for null bits.

    Both sides are packed into blocks of similar numbers of bits. Groups of blocks form a grid; a cell's blocks come to one task in order, the known ones once for each group of new
    ones. Sets of a and b bits have a Tanimoto of at most min / max, so a block of the cell meets a known block only where that
    bound exceeds the worst best value that its items have so far; known blocks come nearest first. No pair becomes a row.
    """
    a, b = fingerprint_blocks(new, rows, True), fingerprint_blocks(known, rows, False)
    n_a, n_b = a.count(), b.count()
    a_groups = max(1, -(-n_a // group))
    b_groups = max(1, -(-n_b // group), min(n_b, -(-2 * new.sparkSession.sparkContext.defaultParallelism // a_groups)))
    dealt = lambda df, mine, groups, other, others, side: df.select(F.pmod("block", F.lit(groups)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), F.lit(side).alias("side"), *blocks_of)
    blocks_of = ["least", "most", "n", "ids", "bits"]
    left = dealt(a, "a_group", a_groups, "b_group", b_groups, 0)
    right = dealt(b.withColumn("ids", F.lit(None).cast(a.schema["ids"].dataType)), "b_group", b_groups, "a_group", a_groups, 1)
    cells = left.unionByName(right).repartition("a_group", "b_group").sortWithinPartitions("a_group", "b_group", "side")

    def search(batches):
        cell, mine = None, []
        for frame in batches:
            for r in frame.itertuples(index=False):
                if (r.a_group, r.b_group) != cell:
                    yield from (m.found() for m in mine)
                    cell, mine = (r.a_group, r.b_group), []
                if r.side == 0:
                    mine.append(Fingerprints(r))
                else:
                    other = Fingerprints(r)
                    for m in mine:
                        m.meet(other)
        yield from (m.found() for m in mine)

    id_type = new.schema["id"].dataType.simpleString()
    found = cells.mapInPandas(search, f"id {id_type}, best double").groupBy("id").agg(F.max("best").alias("best"))
    return new.select("id").distinct().join(found, "id", "left").select("id", (1 - F.coalesce("best", F.lit(0.0))).alias("novelty"))


class Fingerprints:
    """A block as a 0/1 matrix, with the best Tanimoto of each of its items so far."""

    def __init__(self, row):
        self.least, self.most, self.ids = row.least, row.most, row.ids
        at = np.frombuffer(row.bits, np.int32).reshape(-1, 2)
        self.matrix = np.zeros((row.n, 1 + (int(at[:, 1].max()) if len(at) else 0)), np.float32)
        self.matrix[at[:, 0], at[:, 1]] = 1
        self.sizes, self.best, self.met = self.matrix.sum(1), np.zeros(row.n), 0

    def bound(self, other: Fingerprints) -> float:
        """Largest possible Tanimoto between the two blocks, from their numbers of bits."""
        if self.least <= other.most and other.least <= self.most:
            return 1.0 if min(self.most, other.most) else 0.0
        few, many = (self.most, other.least) if self.most < other.least else (other.most, self.least)
        return few / many

    def meet(self, other: Fingerprints) -> None:
        if self.bound(other) <= self.best.min():
            return
        self.met += 1
        width = min(self.matrix.shape[1], other.matrix.shape[1])
        both = self.matrix[:, :width] @ other.matrix[:, :width].T
        union = self.sizes[:, None] + other.sizes[None, :] - both
        self.best = np.maximum(self.best, (both.astype(np.float64) / np.maximum(union, 1)).max(axis=1))

    def found(self) -> pd.DataFrame:
        return pd.DataFrame({"id": self.ids, "best": self.best})


_WORD = re.compile(r"\w+|[^\w\s]")


def bleu_score(reference: str, hypothesis: str, n: int) -> float:
    """Sentence BLEU over words and marks, clipped counts, brevity penalty, 0.1 in place of a zero numerator; 0 without a common word."""
    ref, hyp = _WORD.findall(reference or ""), _WORD.findall(hypothesis or "")
    if not ref or not hyp:
        return 0.0
    logs = 0.0
    for k in range(1, n + 1):
        have = Counter(zip(*[hyp[i:] for i in range(k)], strict=False))
        want = Counter(zip(*[ref[i:] for i in range(k)], strict=False))
        hits = sum(min(c, want[g]) for g, c in have.items())
        if k == 1 and not hits:
            return 0.0
        logs += np.log((hits or 0.1) / max(1, sum(have.values()))) / n
    return float(np.exp(logs) * (1.0 if len(hyp) > len(ref) else np.exp(1 - len(ref) / len(hyp))))


def ngrams(tokens: Column, n: int) -> Column:
    """Array of n-grams as blank-joined strings."""
    last = F.size(tokens) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def common_count(a: Column, b: Column) -> Column:
    """How many elements two sorted arrays have in common, each as often as both have it: one walk along both."""
    step = lambda s, x, y: (
        F.when(x.isNull() | y.isNull(), s)
        .when(x == y, F.struct((s.i + 1).alias("i"), (s.j + 1).alias("j"), (s.n + 1).alias("n")))
        .when(x < y, F.struct((s.i + 1).alias("i"), s.j.alias("j"), s.n.alias("n")))
        .otherwise(F.struct(s.i.alias("i"), (s.j + 1).alias("j"), s.n.alias("n")))
    )
    start = F.struct(*[F.lit(0).alias(c) for c in "ijn"])
    walk = F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b)), start, lambda s, _: step(s, F.get(a, s.i), F.get(b, s.j)), lambda s: s.n)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), walk).otherwise(F.lit(0))


def common_ngrams(tokens: Column, n: int) -> Column:
    """Common n-grams of the fields a and b of a struct of token arrays, as counts (see common_count)."""
    return once(F.struct(F.sort_array(ngrams(tokens["a"], n)).alias("a"), F.sort_array(ngrams(tokens["b"], n)).alias("b")), lambda g: common_count(g["a"], g["b"]))


def bleus(reference: Column, hypothesis: Column, orders: tuple[int, ...] = (2, 4)) -> Column:
    """Sentence BLEU of each order, as a struct of bleu<n>, from one tokenisation and one count of each n-gram length; see bleu_score. Null texts are empty."""
    empty = F.lit("")

    def scores(t: Column) -> Column:
        ref, hyp = F.size(t["a"]), F.size(t["b"])
        brevity = F.when(hyp > ref, F.lit(1.0)).otherwise(F.exp(1 - ref / hyp))
        log = lambda k: F.log(F.greatest(F.get(t["hits"], F.lit(k - 1)).cast("double"), F.lit(0.1)) / F.greatest(F.lit(1), hyp - (k - 1)))
        score = lambda n: brevity * F.exp(reduce(lambda x, y: x + y, [log(k) for k in range(1, n + 1)]) / n)
        some = (ref > 0) & (hyp > 0) & (F.get(t["hits"], F.lit(0)) > 0)
        return F.struct(*[F.when(some, score(n)).otherwise(F.lit(0.0)).alias(f"bleu{n}") for n in orders])

    tokens = F.struct(tokenize(F.coalesce(reference, empty), "word").alias("a"), tokenize(F.coalesce(hypothesis, empty), "word").alias("b"))
    counted = once(tokens, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), F.array(*[common_ngrams(t, k) for k in range(1, max(orders) + 1)]).alias("hits")))
    return once(counted, scores)


def bleu(reference: Column, hypothesis: Column, n: int = 4) -> Column:
    return bleus(reference, hypothesis, (n,))[f"bleu{n}"]


def rouge_n(reference: Column, hypothesis: Column, n: int) -> Column:
    """F-measure over n-gram counts of lower-cased [a-z0-9]+ words, without stemming; 0 if either side has none."""

    def score(t: Column) -> Column:
        a, b = (F.greatest(F.size(t[x]) - (n - 1), F.lit(0)) for x in "ab")
        return F.when((a > 0) & (b > 0), 2.0 * common_ngrams(t, n) / (a + b)).otherwise(F.lit(0.0))

    return once(F.struct(tokenize(reference).alias("a"), tokenize(hypothesis).alias("b")), score)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time: bit i of the state is clear where the first i + 1 words of a have one more in common
    with the words of b so far than the first i have, and one addition with carries moves the whole row on."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_l(reference: Column, hypothesis: Column) -> Column:
    """F-measure of the longest common subsequence of words; 0 if either side has none. A row's work is the product of both lengths, 64 and more cells at a time."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = re.findall("[a-z0-9]+", (x or "").lower()), re.findall("[a-z0-9]+", (y or "").lower())
            out.append(2.0 * lcs_length(p, q) / (len(p) + len(q)) if p and q else 0.0)
        return pd.Series(out)

    return run(reference, hypothesis)


def caption_scores(df: DataFrame, by: list[str], truth: str, caption: str) -> DataFrame:
    """Per `by`, over rows that have a truth: n and the means, times 100, of BLEU-2, BLEU-4, ROUGE-1, ROUGE-2 and ROUGE-L; a null caption scores 0."""
    rows = df.filter(F.col(truth).isNotNull() & (strip(F.col(truth)) != ""))
    t, c = F.col(truth), F.coalesce(caption, F.lit(""))
    rouge = {"rouge1": rouge_n(t, c, 1), "rouge2": rouge_n(t, c, 2), "rouge_l": rouge_l(t, c)}
    rows, parts = rows.select(*by, bleus(t, c).alias("_bleu"), *[v.alias(k) for k, v in rouge.items()]), ["bleu2", "bleu4", *rouge]
    return rows.select(*by, "_bleu.*", *rouge).groupBy(*by).agg(F.count("*").alias("n"), *[(100 * F.avg(k)).alias(k) for k in parts])


#: Fixed value: the distance at which two numbers have nothing in common.
TOLERANCE = 0.1


def tokens_of(text) -> frozenset:
    return frozenset(str(text).lower().split())


def jaccard_of(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def number_similarity(a, b) -> float:
    return max(0.0, 1 - abs(float(a) - float(b)) / TOLERANCE)


def label_similarity(a, b) -> float:
    return float(str(a).strip().lower() == str(b).strip().lower())


def structure_similarity(a, b) -> float:
    """Tanimoto of two lists of on-bits; 0 if either is empty, as of a structure that could not be read."""
    return jaccard_of(frozenset(a or ()), frozenset(b or ()))


def set_similarity(a, b) -> float:
    """Of two lists of parts (dicts of canonical, bits): 1 for equal multisets of canonical forms, else the mean over the parts of a of the best Tanimoto among those of b."""
    if sorted(p["canonical"] or "" for p in a) == sorted(p["canonical"] or "" for p in b):
        return 1.0
    return sum(max((structure_similarity(p["bits"], q["bits"]) for q in b), default=0.0) for p in a) / max(1, len(a))


def cosine_similarity(a, b) -> float:
    """0 for vectors of different length and for vectors without a direction."""
    x, y = (np.array([np.nan if v is None else v for v in c], np.float64) for c in (a, b))
    if len(x) != len(y):
        return 0.0
    norm = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / norm) if np.isfinite(norm) and norm > 0 else 0.0


#: Kind -> (similarity of plain values, threshold), for the greedy clusters.
SIMILARITIES = {
    "text": (lambda a, b: jaccard_of(tokens_of(a), tokens_of(b)), 0.80),
    "numeric": (number_similarity, 0.90),
    "label": (label_similarity, 0.99),
    "reasoning": (lambda a, b: jaccard_of(tokens_of(a), tokens_of(b)), 0.75),
    "structure": (structure_similarity, 0.85),
    "set": (set_similarity, 0.85),
    "embedding": (cosine_similarity, 0.80),
}
