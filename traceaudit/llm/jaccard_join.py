"""N-gram Jaccard join with signature trees, and the components of its links.

A text is the set of the 64-bit hashes of its distinct k-word shingles. The steps:

1. Frequent shingles come from lossy counting over all texts; they only order shingles (rare before frequent), which
   changes the cost and never the result, so the bounded table of them may be sent to all tasks.
2. Sets that are equal are one node, kept by their smallest doc_id.
3. Two sets that link share at least l = min(max(1, n // 20)) shingles among the first n - ceil(0.8 n) + max(1, n // 20) of each in that order
   (prefix filter with more than one shared token). Shingles whose sets have no partner of a size that could link drop out, and so do
   sets that are left with too few shingles to link with any.
4. First round: each set meets the sets that share its first or its second such shingle, in chunks of bounded size. A chunk
   is a signature tree: nodes hold the OR of their sets' token bitmaps, a size range and the most bits lost to
   collisions; a dual traversal prunes node pairs by the largest overlap they allow, and node pairs that are already one
   component. What remains is checked exactly.
5. Second round: only shingles whose sets are not yet in one component matter. Their sets meet in trees of signatures alone (few sets pair by pair), all pairs of
   chunks included but those of the largest component of a shingle among themselves; pairs that survive are checked exactly. No link
   between sets of different components is lost. Shingles of one family of sets are dealt together, as their rows are alike, in deals of bounded size;
   the pairs of chunks of a shingle are deals of their own, so a shingle or a family of very many sets is many pieces.
   A pair that shares many shingles is named where it meets first, in the order of falling frequency: each set brings the few of its shingles along that
   come first and before the shingle at hand, and a pair that has one of them in common has met there. Each set also brings a bitmap of the prefix shingles
   that it shares with other components, and a pair is named only if these bitmaps allow as many common ones as a link has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.common import WordHashes, cut, hashed_texts, in_runs, may_be_in, mix64, pack_sorted, pieces_of, planes, shingle_hashes, slices_of, small_or_shuffled, sorted_runs, unpack_sorted, unplanes, words_of
from traceaudit.llm.components import components
from traceaudit.session import table

WORDS = 5
#: Shingles that the table of frequent ones holds at most.
FREQUENT = 50_000
#: Sets of one chunk, about; chunks are dealt by a hash.
CHUNK = 512
BITS = 2048
#: Most common shingles of a set that travel with it in the second round, to tell where a pair has met before.
LOWS = 4
#: Signature rows of one deal of the second round, about.
DEAL_ROWS = 10_000
FANOUT = 8
#: Bytes of texts whose words are arrays at once, about: some 30 times as much memory.
TEXT_BYTES = 500_000
#: Sets of a shingle that meet in the second round pair by pair, without trees and bands.
PAIRED = 64
#: Rows that are Python objects at once in a task.
TASK_ROWS = 1000


def set_of(text: str | None, hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; empty for a null or wordless one."""
    return np.unique(shingle_hashes(hashes.of(words_of(text)), k))


def sets_of(texts: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """As set_of, of all texts of an Arrow array, many at once; the hashes of words are others."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes, dtype=np.int64) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
    return [s for i, j in zip(cuts[:-1], cuts[1:], strict=True) for s in sets_of_piece(texts.slice(i, j - i), k)]


def sets_of_piece(texts: pa.Array, k: int) -> list[np.ndarray]:
    h, at = hashed_texts(texts)
    whole = shingle_hashes(h, k)
    return [distinct(whole[i : j - k + 1] if j - i >= k else shingle_hashes(h[i:j], k)) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def distinct(h: np.ndarray) -> np.ndarray:
    """As np.unique, which takes four times as long for some hundred hashes."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow array of lists of longs."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def frequent_shingles(docs: DataFrame, k: int = WORDS, most: int = FREQUENT) -> np.ndarray:
    """At most `most` shingles of the highest document counts, sorted. Each task forgets shingles of fewer than 3 of TASK_ROWS texts."""

    def count(batches):
        for batch in pieces_of(batches, TASK_ROWS):
            h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets_of(batch.column(0), k)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n >= 3].view(np.int64)), pa.array(n[n >= 3])], ["h", "n"])

    counts = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.filter("n >= 8").orderBy(F.desc("n"), "h").limit(most).toPandas()
    return np.sort(top["h"].to_numpy(np.int64).view(np.uint64))


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + max(1, n // 20) if n else 0


def least_shared() -> Column:
    """So many prefix shingles a set of n shares with any set that it links with, which has at least 0.8 n."""
    return F.greatest(F.lit(1), F.floor(F.col("n") * 4 / 100))


def shingle_sets(docs: DataFrame, frequent: np.ndarray, k: int = WORDS) -> DataFrame:
    """(doc_id, n, f1, f2, rare, hot): set size, a 128-bit fingerprint of the set, and its prefix, split into rare and frequent shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        hot = shared.value
        for batch in pieces_of(batches, TASK_ROWS):
            out = [[], [], [], [], []]
            for s in sets_of(batch.column(1), k):
                p = prefix_length(len(s))
                common = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)
                rare = s[~common][:p]
                kept = s[common][: p - len(rare)]
                f1, f2 = mix64(s + np.uint64(1)), mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                for column, v in zip(out, (len(s), int(f1.sum(dtype=np.uint64).view(np.int64)), int(f2.sum(dtype=np.uint64).view(np.int64)), rare, kept), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), lists_of(out[3]), lists_of(out[4])],
                ["doc_id", "n", "f1", "f2", "rare", "hot"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, rare array<long>, hot array<long>")


class Node:
    """A leaf of sets or a node of nodes: OR of bitmaps, size range, most tokens beyond one a bit."""

    __slots__ = ("bits", "low", "high", "excess", "kids", "items", "one")

    def __init__(self, parts, kids, items):
        self.bits, self.low, self.high, self.excess = 0, parts[0][1], 0, 0
        for bits, low, high, excess in parts:
            self.bits |= bits
            self.low, self.high, self.excess = min(self.low, low), max(self.high, high), max(self.excess, excess)
        self.kids, self.items, self.one = kids, items, None

    def parts(self):
        return self.bits, self.low, self.high, self.excess


def possible(a, b) -> bool:
    """Whether sets below a and b, given as (bits, low, high, excess), may have 100 * intersection >= 80 * union."""
    bits_a, low_a, high_a, excess_a = a
    bits_b, low_b, high_b, excess_b = b
    if 5 * high_a < 4 * low_b or 5 * high_b < 4 * low_a:
        return False
    return 9 * ((bits_a & bits_b).bit_count() + min(excess_a, excess_b)) >= 4 * (low_a + low_b)


def build(stats: list[tuple]) -> Node:
    """A tree over sets with stats (bits, n, n, excess), which are neighbours where their sizes and bitmaps are."""
    order = sorted(range(len(stats)), key=lambda i: (stats[i][1], stats[i][0]))
    level = [Node([stats[i] for i in part], None, part) for part in (order[i : i + FANOUT] for i in range(0, len(order), FANOUT))]
    while len(level) > 1:
        level = [Node([x.parts() for x in part], part, None) for part in (level[i : i + FANOUT] for i in range(0, len(level), FANOUT))]
    return level[0]


class Forest:
    """Union-find over the sets of a chunk."""

    def __init__(self, groups: list):
        first: dict = {}
        self.up = [first.setdefault(g, i) for i, g in enumerate(groups)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def one(self, node: Node) -> int | None:
        """The component of all sets below the node, or None where there are several."""
        if node.one is not None:
            return self.find(node.one)
        found = {self.find(i) for i in node.items} if node.items is not None else {self.one(x) for x in node.kids}
        if len(found) == 1 and None not in found:
            node.one = next(iter(found))
            return node.one
        return None

    def traverse(self, root: Node, stats: list[tuple], other: Node | None, link) -> None:
        """Dual traversal of root with itself, or with other. link(i, j) says whether sets i and j became one component."""
        todo = [(root, other or root)]
        while todo:
            a, b = todo.pop()
            mine = self.one(a)
            if mine is not None and mine == self.one(b) or not possible(a.parts(), b.parts()):
                continue
            if a.items is not None and b.items is not None:
                for n, i in enumerate(a.items):
                    for j in a.items[n + 1 :] if a is b else b.items:
                        x, y = self.find(i), self.find(j)
                        if x != y and possible(stats[i], stats[j]) and link(i, j):
                            self.up[max(x, y)] = min(x, y)
            elif a is b:
                todo += [(x, y) for n, x in enumerate(a.kids) for y in a.kids[n + 1 :]] + [(x, x) for x in a.kids]
            elif b.items is not None or a.items is None and a.high - a.low >= b.high - b.low:
                todo += [(x, b) for x in a.kids]
            else:
                todo += [(a, x) for x in b.kids]


def bitmap(s: np.ndarray) -> tuple[int, int]:
    """(bits, excess) of a set: which of BITS buckets have tokens, and how many tokens there are beyond one a bucket."""
    mask = np.zeros(BITS, bool)
    mask[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
    bits = int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")
    return bits, len(s) - int(mask.sum())


def mark(batches):
    """(doc_id, lows, marks, marks_excess) of (doc_id, lows, h): the bitmap of a set's shingles h."""
    for batch in pieces_of(batches, TASK_ROWS):
        lists = batch.column(2)
        values, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        maps = [bitmap(values[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)]
        columns = [batch.column(0), batch.column(1), pa.array([m[0].to_bytes(BITS // 8, "little") for m in maps], pa.binary()), pa.array([m[1] for m in maps], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lows", "marks", "marks_excess"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def runs(batches, keys: int):
    """Lists of rows with the same first `keys` columns, from batches sorted by them; a list holds one chunk."""
    held, key = [], None
    for batch in pieces_of(batches, TASK_ROWS):
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                held, key = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield key, held


def first_round(batches):
    """Links (a, b) of each chunk (key, chunk, doc_id, cells): a star for each of its components. A doc_id with several sets comes with each of them."""
    for _, rows in runs(batches, 2):
        rows = list(dict.fromkeys(rows))
        if len(rows) > 1:
            sets = [np.frombuffer(r[1], np.uint64) for r in rows]
            stats = [(bits, len(s), len(s), excess) for s in sets for bits, excess in (bitmap(s),)]
            forest = Forest(range(len(rows)))
            forest.traverse(build(stats), stats, None, lambda i, j: linked(sets[i], sets[j]))  # noqa: B023
            least: dict[int, int] = {}
            for i, r in enumerate(rows):
                least[forest.find(i)] = min(r[0], least.get(forest.find(i), r[0]))
            yield from pairs_batch([(r[0], least[forest.find(i)]) for i, r in enumerate(rows) if r[0] != least[forest.find(i)]])


def whole_runs(batches, keys: int):
    """(rows, starts): batches of rows sorted by the first `keys` columns, cut where a run of equal keys ends, and where their runs start."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        new = np.ones(batch.num_rows, bool)
        new[1:] = False
        for c in range(keys):
            key = batch.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield batch.slice(0, last), starts[:-1]
        held = batch.slice(last)
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def bits_of(column: pa.Array) -> np.ndarray:
    """Bitmaps of a binary column as rows of 64-bit numbers."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint64, len(column) * BITS // 64, at).reshape(len(column), BITS // 64)


def meeting(starts: np.ndarray, ends: np.ndarray):
    """(x, y): all pairs of rows of each run from a start to an end, in pieces of bounded size."""
    size = ends - starts
    rows = np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)
    later = np.repeat(ends, size) - 1 - rows  # so many rows of its run follow a row
    piece = np.cumsum(later) // (2 * TASK_ROWS)
    for p in np.unique(piece).tolist():
        x, n = rows[piece == p], later[piece == p]
        yield np.repeat(x, n), np.repeat(x + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())


def second_round(batches):
    """Pairs (a, b) that may link, of each pair of chunks (family, salt, h, band, i, j, doc_id, side, component, n, excess, signature, earlier, marks, marks_excess)."""
    for batch, starts in whole_runs(pieces_of(batches, TASK_ROWS), 6):
        ends = np.append(starts[1:], batch.num_rows)
        size = ends - starts
        few = (size > 1) & (size <= PAIRED)
        yield from paired(batch, starts[few], ends[few])
        for lo, hi in zip(starts[size > PAIRED].tolist(), ends[size > PAIRED].tolist(), strict=True):
            yield from treed(batch.slice(lo, hi - lo))


def paired(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray):
    """second_round of runs of few rows: a tree would be little more than its leaves, so all pairs are looked at, many runs at once."""
    i, j, doc, side, part, n, excess, marks_excess = (batch.column(c).to_numpy(zero_copy_only=False) for c in (4, 5, 6, 7, 8, 9, 10, 14))
    signature, marks = (bits_of(batch.column(c)) for c in (11, 13))
    lows = batch.column(12).fill_null([])
    seen = np.zeros((batch.num_rows, max(1, pc.max(lows.value_lengths()).as_py() or 0)), np.int64)
    known = np.arange(seen.shape[1]) < lows.value_lengths().to_numpy(zero_copy_only=False)[:, None]
    seen[known] = lows.flatten().to_numpy(zero_copy_only=False)

    def common(bits, x, y):
        return np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64)

    for x, y in meeting(starts, ends):
        ok = (part[x] != part[y]) & ((i[x] == j[x]) | (side[x] != side[y])) & (5 * n[x] >= 4 * n[y]) & (5 * n[y] >= 4 * n[x])
        x, y = x[ok], y[ok]
        ok = 9 * (common(signature, x, y) + np.minimum(excess[x], excess[y])) >= 4 * (n[x] + n[y])  # see possible
        x, y = x[ok], y[ok]
        ok = common(marks, x, y) + np.minimum(marks_excess[x], marks_excess[y]) >= np.maximum(1, 4 * np.maximum(n[x], n[y]) // 100)  # see least_shared
        x, y = x[ok], y[ok]
        met = (seen[x][:, :, None] == seen[y][:, None, :]) & known[x][:, :, None] & known[y][:, None, :]
        ok = ~met.any((1, 2))
        if ok.any():
            a, b = doc[x[ok]], doc[y[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def treed(batch: pa.RecordBatch):
    """second_round of one run of many rows, by dual traversal of signature trees."""
    i, j = batch.column(4)[0].as_py(), batch.column(5)[0].as_py()
    rows = list(zip(*[c.to_pylist() for c in batch.columns[6:]], strict=True))
    stats = [(int.from_bytes(r[5], "little"), r[3], r[3], r[4]) for r in rows]
    earlier = [frozenset(r[6] or ()) for r in rows]
    marks = [int.from_bytes(r[7], "little") for r in rows]
    found = set()

    def note(x, y):
        least = max(1, 4 * max(rows[x][3], rows[y][3]) // 100)  # see least_shared
        if (marks[x] & marks[y]).bit_count() + min(rows[x][8], rows[y][8]) >= least and earlier[x].isdisjoint(earlier[y]):
            found.add((min(rows[x][0], rows[y][0]), max(rows[x][0], rows[y][0])))

    if i == j:
        Forest([r[2] for r in rows]).traverse(build(stats), stats, None, note)
    else:
        sides = [[x for x, r in enumerate(rows) if r[1] == s] for s in (0, 1)]
        if all(sides):
            trees = [build_of(stats, side) for side in sides]
            Forest([r[2] for r in rows]).traverse(trees[0], stats, trees[1], note)
    yield from pairs_batch(sorted(found))


def build_of(stats: list[tuple], items: list[int]) -> Node:
    root = build([stats[i] for i in items])
    todo = [root]
    while todo:
        node = todo.pop()
        if node.items is not None:
            node.items = [items[i] for i in node.items]
        else:
            todo += node.kids
    return root


def pairs_batch(pairs: list[tuple[int, int]]):
    if pairs:
        a, b = zip(*pairs, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def send_prefixes(bits: int):
    """Rare prefix shingles of (doc_id, n, rare) as packed slices by hash range: (slice, keys, docs, sizes)."""

    def run(batches):
        for batch in pieces_of(batches, 4 * TASK_ROWS):
            lists = batch.column(2)
            keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            order = np.argsort(keys)
            docs, sizes = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), counts)[order] for i in (0, 1))
            keys = keys[order]
            for s, lo, hi in slices_of(keys, bits):
                data = pack_sorted(keys[lo:hi]), planes(docs[lo:hi]), planes(sizes[lo:hi].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([s]), *[pa.array([x], pa.binary()) for x in data]], ["slice", "keys", "docs", "sizes"])

    return run


def find_shared(batches):
    """(h, doc_id, n, size): shingles of a slice with the sets that have a partner of a size that could link there."""
    for rows in sorted_runs(batches, ("slice",)):
        keys = np.concatenate([unpack_sorted(r["keys"]) for r in rows])
        docs, sizes = (np.concatenate([unplanes(r[c], kind) for r in rows]) for c, kind in (("docs", np.int64), ("sizes", np.int32)))
        order = np.lexsort((sizes, keys))
        keys, docs, sizes = keys[order], docs[order], sizes[order].astype(np.int64)
        near = (keys[1:] == keys[:-1]) & (5 * sizes[:-1] >= 4 * sizes[1:])
        kept = np.zeros(len(keys), bool)
        kept[1:] |= near
        kept[:-1] |= near
        _, inverse, counts = np.unique(keys[kept], return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys[kept].view(np.int64)), pa.array(docs[kept]), pa.array(sizes[kept]), pa.array(counts[inverse])], ["h", "doc_id", "n", "size"])


def shared_prefixes(sets: DataFrame, total: int, slice_keys: int = 500_000) -> DataFrame:
    """(h, hot, doc_id, n, size): prefix shingles that sets of sizes that could link share, of sets with enough of them; size: how many sets have the shingle.
    total: how many rare prefix shingles there are, about.

    Rare shingles travel packed, in one exchange; frequent ones, whose table is bounded, are counted with partial sums.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, total / slice_keys)))))
    sent = sets.filter(F.size("rare") > 0).select("doc_id", "n", "rare").mapInArrow(send_prefixes(bits), "slice long, keys binary, docs binary, sizes binary")
    rare = in_runs(sent, ["slice"], ["slice"]).mapInArrow(find_shared, "h long, doc_id long, n long, size long")
    hot = sets.filter(F.size("hot") > 0).select(F.explode("hot").alias("h"), "doc_id", "n")
    sizes = hot.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1")  # at most FREQUENT rows
    hot = hot.join(F.broadcast(sizes), "h")
    shared = cut(rare.select("h", F.lit(0).alias("hot"), "doc_id", "n", "size").union(hot.select("h", F.lit(1), "doc_id", "n", "size")), "jaccard-shared")
    enough = cut(shared.groupBy("doc_id", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= least_shared()).select("doc_id").distinct(), "jaccard-enough")
    return shared.join(enough, "doc_id")


def cell_table(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, excess, signature, cells) of the documents in ids(doc_id)."""

    def run(batches):
        for batch in pieces_of(batches, TASK_ROWS):
            sets = sets_of(batch.column(1), k)
            maps = [bitmap(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[1] for m in maps], pa.int64()), pa.array([m[0].to_bytes(BITS // 8, "little") for m in maps], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc_id", "n", "excess", "signature", "cells"],
            )

    texts = may_be_in(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", ids).join(ids, "doc_id")
    return cut(texts.mapInArrow(run, "doc_id long, n long, excess long, signature binary, cells binary"), "jaccard-cells")


def component_table(docs: DataFrame, k: int = WORDS, chunk: int = CHUNK, most: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Texts of fewer than k words are one shingle of all their words; null and wordless texts have no shingles and link with nothing.
    Rows that repeat a doc_id are one node, which has the links of all its texts, and n_shingles of their own; a null doc_id takes no part
    in links and has a null component_id. Other columns are ignored.
    """
    sets = cut(shingle_sets(docs, frequent_shingles(docs, k, most), k), "jaccard-sets")
    real = sets.filter("n > 0 AND doc_id IS NOT NULL")
    firsts = cut(real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1"), "jaccard-copies")
    copies = cut(real.select("doc_id", "f1", "f2", "n").join(firsts.drop("copies"), ["f1", "f2", "n"]).filter("doc_id <> first_id").distinct(), "jaccard-copies")
    several = cut(real.groupBy("doc_id").agg(*[f(c).alias(f"{c}_{x}") for c in ("f1", "n") for x, f in (("lo", F.min), ("hi", F.max))]).filter("f1_lo <> f1_hi OR n_lo <> n_hi").select("doc_id"), "jaccard-several")  # ids with different texts
    total = real.agg(F.sum(F.size("rare"))).first()[0] or 0
    firsts = may_be_in(real, "doc_id", copies).join(copies.drop("first_id"), ["doc_id", "f1", "f2", "n"], "left_anti").unionByName(may_be_in(real, "doc_id", copies, others=True))
    prefixes = cut(shared_prefixes(firsts, total), "jaccard-prefixes")

    cells = cell_table(docs, cut(prefixes.select("doc_id").distinct(), "jaccard-ids"), k)
    ranked = F.slice(F.sort_array(F.collect_list(F.struct("hot", "h", "size"))), 1, 2)
    keyed = prefixes.groupBy("doc_id").agg(ranked.alias("keys")).select("doc_id", F.posexplode("keys").alias("turn", "key"))
    keyed = keyed.select("doc_id", F.col("key.h").alias("h"), F.pmod(F.xxhash64("doc_id", "turn"), F.ceil(F.col("key.size") / chunk)).alias("part"))
    chunks = in_runs(keyed.join(cells.select("doc_id", "cells"), "doc_id").select("h", "part", "doc_id", "cells"), ["h", "part"], ["h", "part"])
    links = cut(chunks.mapInArrow(first_round, "a long, b long").distinct(), "jaccard-links")
    parts = cut(components(links), "jaccard-parts").withColumnsRenamed({"node": "doc_id", "component": "part_id"})

    placed = prefixes.join(parts, "doc_id", "left").withColumn("part_id", F.coalesce("part_id", "doc_id"))
    split = placed.groupBy("h").agg(F.min("part_id").alias("lo"), F.max("part_id").alias("hi")).filter("lo <> hi").select("h", F.col("lo").alias("family"))
    rest = cut(placed.join(split, "h").select("h", "family", "doc_id", "part_id", "size"), "jaccard-rest")
    # of each set, what the second round works with: shingles that two components share are all here, most common first
    ranked = F.sort_array(F.collect_set(F.struct((-F.col("size")).alias("rank"), "h")))
    shared = rest.groupBy("doc_id").agg(ranked.alias("ranked")).select("doc_id", F.slice("ranked", 1, LOWS).alias("lows"), F.transform("ranked", lambda g: g["h"]).alias("h"))
    shared = cut(shared.mapInArrow(mark, "doc_id long, lows array<struct<rank:long,h:long>>, marks binary, marks_excess long"), "jaccard-marks")
    # of a shingle with more sets than a chunk, sets of its largest component need not meet each other
    largest = rest.filter(F.col("size") > 4 * chunk).groupBy("h", "part_id").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("part_id", "c").alias("major"), F.max("c").alias("n_major"))
    parts_of = lambda n: F.ceil(n / (4 * chunk)).cast("int")
    rest = (
        rest.join(small_or_shuffled(cut(largest, "jaccard-largest")), "h", "left")
        .withColumn("n_first", F.coalesce(parts_of(F.col("n_major")), F.lit(0)))  # chunks of the largest component come first
        .withColumn("n_other", parts_of(F.greatest(F.col("size") - F.coalesce("n_major", F.lit(0)), F.lit(1))))
        .withColumn("first", F.coalesce(F.col("part_id") == F.col("major"), F.lit(False)))
    )
    many = F.col("size") > PAIRED
    meets = F.when(many, 2).otherwise(1) * F.when(F.col("first"), F.col("n_other")).otherwise(F.col("n_first") + F.col("n_other"))  # signature rows of a set: two bands, each chunk that it meets
    families = cut(rest.groupBy("family").agg(F.ceil(F.sum(meets) / DEAL_ROWS).alias("n_deals")).filter("n_deals > 1"), "jaccard-families")
    one_text = ~F.coalesce("has_more", F.lit(False))  # what holds for one of several texts does not for the others
    nodes = cells.drop("cells").join(shared, "doc_id").join(small_or_shuffled(several.withColumn("has_more", F.lit(True))), "doc_id", "left").withColumn("lows", F.when(one_text, F.col("lows"))).drop("has_more")
    earlier = F.transform(F.filter("lows", lambda g: g < F.struct((-F.col("size")).alias("rank"), "h")), lambda g: g["h"])
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.26)))  # sets that link differ by a factor of at most 1.25, so by one band at most
    deal = F.when(F.col("n_first") + F.col("n_other") > 1, F.xxhash64("h", "band", "i", "j")).otherwise(F.xxhash64("h"))
    tree_rows = (
        rest.join(small_or_shuffled(families), "family", "left")
        .join(nodes, "doc_id")
        .withColumn("band", F.explode(F.when(many, F.array(band, band + 1)).otherwise(F.array(F.lit(0).cast("long")))))
        .withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.when(F.col("first"), F.col("n_first")).otherwise(F.col("n_other"))).cast("int") + F.when(F.col("first"), 0).otherwise(F.col("n_first")))
        .withColumn("with", F.explode(F.sequence(F.when(F.col("first"), F.col("n_first")).otherwise(0), F.col("n_first") + F.col("n_other") - 1)))
        .withColumns({"i": F.least("mine", "with"), "j": F.greatest("mine", "with")})
        .withColumn("salt", F.pmod(deal, F.coalesce("n_deals", F.lit(1))))
        .select("family", "salt", "h", "band", "i", "j", "doc_id", (F.col("mine") > F.col("with")).cast("int").alias("side"), "part_id", "n", "excess", "signature", earlier.alias("earlier"), "marks", "marks_excess")
    )
    maybe = in_runs(tree_rows, ["family", "salt"], ["family", "salt", "h", "band", "i", "j"]).mapInArrow(second_round, "a long, b long")
    maybe = maybe.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = [cells.select(F.col("doc_id").alias(x), F.col("cells").alias(f"cells_{x}")) for x in ("a", "b")]

    def check(batches):
        for batch in pieces_of(batches, TASK_ROWS):
            yield from pairs_batch([(a, b) for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True) if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))])

    more = maybe.join(sides[0], "a").join(sides[1], "b").select("a", "b", "cells_a", "cells_b").mapInArrow(check, "a long, b long")
    old = parts.filter("doc_id <> part_id").select(F.col("doc_id").alias("a"), F.col("part_id").alias("b"))
    same = copies.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    final = components(cut(more.union(old).union(same), "jaccard-links")).withColumnsRenamed({"node": "first_id", "component": "component_id"})
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles"))
        .join(copies.groupBy("doc_id").agg(F.min("first_id").alias("first_id")), "doc_id", "left")
        .withColumn("first_id", F.coalesce("first_id", "doc_id"))
        .join(final, "first_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "first_id").alias("component_id"))
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id; all columns stay."""
    found = component_table(docs)
    gone = cut(found.filter("doc_id <> component_id").select("doc_id").distinct(), "jaccard-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents, whole texts, five-word shingles."""
    return component_table(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE 100 * c >= 80 * (an + bn - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, to_id) AS (SELECT DISTINCT doc_id, doc_id FROM s UNION SELECT r.doc_id, x.b FROM r JOIN both_ways x ON x.a = r.to_id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, m.component_id
FROM s JOIN (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""
