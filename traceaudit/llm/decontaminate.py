"""Benchmark decontamination by greedy string tiling.

Seeds are the word k-grams of benchmark items. The steps, on distinct texts and distinct items:

1. Seeds are a table (item, k, hash, position). A bit table of fixed size, made from their hashes, tells each scan of the texts which k-grams
   can't be seeds; the k-grams that are left go to the join as (text, hash). A larger benchmark lets more of them through and changes no result.
2. A text that tiles enough of an item shares at least m of its seeds, so it shares one of all but its m - 1 most frequent ones (prefix
   filter). An equi-join on hashes over those gives the candidate pairs; phrases that many items and texts share pair nothing.
3. For each candidate pair the longest match that overlaps no earlier one is marked again and again. Each round finds the greatest length with
   running Karp-Rabin hashes over what is unmarked. The share of the item that is tiled decides; the order of the tiles
   does not matter, so reordered passages count too.

Only candidates' texts move. All copies of a text are tiled once.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.llm.common import WordHashes, cut, pieces_of, shingle_hashes, small_or_shuffled
from traceaudit.session import table

#: Shortest tile in words; an item with fewer words has to match as a whole.
LEAST_TILE = 4
#: An item counts as contaminating once this share of its words is tiled.
COVERAGE = 0.5
#: Rows that are Python objects at once in a task.
TASK_ROWS = 500
#: The bit table has 2 ** TABLE_BITS bits.
TABLE_BITS = 24
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
TEXT = ["t1", "t2"]  # two 64-bit hashes stand for a text


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def text_key() -> list:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def items_of(bench: DataFrame) -> DataFrame:
    """(item, text, item_id, n_items): distinct texts of bench(item_id, text), with the smallest of their ids and how many rows have them."""
    texts = bench.filter("text IS NOT NULL").groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"), F.count("*").alias("n_items"))
    return cut(texts.select(F.md5("text").alias("item"), "text", "item_id", "n_items"), "tiles-items")


def seed_table(items: DataFrame, least: int) -> DataFrame:
    """(item, k, n_words, h, q): hash and position of each k-gram of an item; k is `least` or, for a shorter item, its length."""

    def run(batches):
        hashes = WordHashes()
        for batch in pieces_of(batches, TASK_ROWS):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                h = shingle_hashes(hashes.of(words), least)
                n = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * n, pa.string()), pa.array([min(least, len(words))] * n, pa.int32()), pa.array([len(words)] * n, pa.int32()), pa.array(h.view(np.int64)), pa.array(np.arange(n, dtype=np.int32))],
                    ["item", "k", "n_words", "h", "q"],
                )

    return cut(items.select("item", "text").mapInArrow(run, "item string, k int, n_words int, h long, q int"), "tiles-seeds")


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64), (h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


def bit_table(seeds: DataFrame) -> bytes:
    """The bits of all seed hashes, packed. What the driver gets is at most 2 ** TABLE_BITS / 64 rows, however many seeds there are."""
    mask = (1 << TABLE_BITS) - 1
    bits = F.array(F.shiftrightunsigned("h", 64 - TABLE_BITS).bitwiseAND(F.lit(mask)), F.col("h").bitwiseAND(F.lit(mask)))
    bits = seeds.select(F.explode(bits).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("word")).toPandas()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
    return table.tobytes()


def text_hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(t1, t2, h): k-grams of each distinct text that may be seeds."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(bit_table(seeds))
    widths = sorted(r["k"] for r in seeds.select("k").distinct().collect())  # at most LEAST_TILE values

    def run(batches):
        bits = np.unpackbits(np.frombuffer(table.value, np.uint8), bitorder="little").astype(bool)
        hashes = WordHashes()
        for batch in pieces_of(batches, TASK_ROWS):
            found = []
            for text in batch.column(2).to_pylist():
                mine = hashes.of(tokens(text))
                kept = []
                for k in widths:
                    if len(mine) >= k:
                        h = shingle_hashes(mine, k)
                        a, b = places(h)
                        may = np.flatnonzero(bits[a])
                        kept.append(h[may[bits[b[may]]]])
                found.append(np.unique(np.concatenate(kept)) if kept else np.empty(0, np.uint64))
            sizes = [len(f) for f in found]
            keys = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], [*TEXT, "h"])

    return cut(docs.select(*text_key(), "text").mapInArrow(run, "t1 long, t2 long, h long").distinct(), "tiles-hits")


def candidates(hits: DataFrame, seeds: DataFrame, coverage: float) -> DataFrame:
    """(t1, t2, item): pairs that may reach the coverage. Tiles over W words of an item begin at no fewer than W / k of its seeds' positions."""
    often = seeds.join(hits.groupBy("h").agg(F.count("*").alias("n_texts")), "h", "left").withColumn("n_texts", F.coalesce("n_texts", F.lit(0)))
    need = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n_words") * coverage) / F.col("k")))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n_texts", "q"))  # an item's own positions
    rare = often.withColumn("rank", rank).filter(F.col("rank") <= F.col("n_words") - F.col("k") + 1 - need + 1).filter("n_texts > 0")
    return hits.join(rare.select("h", "item"), "h").select(*TEXT, "item").distinct()


class Windows:
    """Running Karp-Rabin hashes of all windows of one sequence, at any width."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        steps = np.full(n + 1, _BASE)
        steps[0] = 1
        back = np.full(n + 1, _INVERSE)
        back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((ids + 2).astype(np.uint64) * np.cumprod(steps, dtype=np.uint64)[:n], dtype=np.uint64)])
        self.ids, self.marked = ids, ids < 0

    def free(self, width: int) -> np.ndarray:
        """Places of windows of this width without a marked word."""
        if len(self.ids) < width:
            return np.empty(0, np.int64)
        taken = np.concatenate([[0], np.cumsum(self.marked)])
        return np.flatnonzero(taken[width:] == taken[:-width])

    def at(self, places: np.ndarray, width: int) -> np.ndarray:
        return (self.sums[places + width] - self.sums[places]) * self.back[places]


def common(text: Windows, item: Windows, width: int) -> list[tuple[int, list[int]]]:
    """(place in the item, places in the text) of equal unmarked windows, by place in the item."""
    p, q = text.free(width), item.free(width)
    if not len(p) or not len(q):
        return []
    hp, hq = text.at(p, width), item.at(q, width)
    order = np.argsort(hp, kind="stable")
    p, hp = p[order], hp[order]
    low, high = np.searchsorted(hp, hq, "left"), np.searchsorted(hp, hq, "right")
    out = []
    for b, lo, hi in zip(q[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
        if np.array_equal(text.ids[p[lo] : p[lo] + width], item.ids[b : b + width]):
            out.append((b, p[lo:hi].tolist()))
    return out


def tile(words: list[str], item_words: list[str], least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiles (text position, item position, length): longest first, then by item and text position."""
    k = min(least, len(item_words))
    if not k or len(words) < k:
        return []
    numbers: dict[str, int] = {}
    item_ids = np.array([numbers.setdefault(w, len(numbers)) for w in item_words], np.int64)
    text_ids = np.array([numbers.get(w, -1) for w in words], np.int64)
    # what of the text stands in no k-gram of the item can't be tiled; each gap is one word that matches nothing
    whole, item = Windows(text_ids), Windows(item_ids)
    places = whole.free(k)
    places = places[np.isin(whole.at(places, k), item.at(item.free(k), k))]
    near = np.zeros(len(words) + 1, np.int64)
    np.add.at(near, places, 1)
    np.add.at(near, places + k, -1)
    near = np.cumsum(near[:-1]) > 0
    kept = np.flatnonzero(near | np.concatenate([[False], near[:-1]]))
    text = Windows(np.where(near[kept], text_ids[kept], -1))
    tiles = []
    while True:
        width, found = k, common(text, item, k)
        if not found:
            return tiles
        low, high = k, min(len(kept), len(item_ids)) + 1  # a match of `low` words exists, none of `high`
        step = k
        while high - low > 1:
            middle = min(low + step, high - 1) if step else (low + high) // 2
            more = common(text, item, middle)
            if more:
                low, width, found, step = middle, middle, more, 2 * step
            else:
                high, step = middle, 0
        for q, places in found:
            if item.marked[q : q + width].any():
                continue
            for p in places:
                if not text.marked[p : p + width].any():
                    text.marked[p : p + width] = item.marked[q : q + width] = True
                    tiles.append((int(kept[p]), q, width))
                    break


def tiled_texts(docs: DataFrame, bench: DataFrame, least: int = LEAST_TILE, coverage: float = COVERAGE) -> DataFrame:
    """(t1, t2, item_id, n_items, n_tiles, tiled_words, item_words, coverage) of distinct texts and items, from `coverage` on."""
    items = items_of(bench)
    seeds = seed_table(items, least)
    hits = text_hits(docs, seeds)
    pairs = cut(candidates(hits, seeds, coverage), "tiles-pairs")
    wanted = cut(pairs.select(*TEXT).distinct(), "tiles-wanted")
    texts = docs.select(*text_key(), "text").join(small_or_shuffled(wanted), TEXT, "left_semi").groupBy(*TEXT).agg(F.first("text").alias("text"))
    both = pairs.join(texts, TEXT).join(items.select("item", F.col("text").alias("item_text"), "item_id", "n_items"), "item")

    def run(batches):
        for batch in pieces_of(batches, TASK_ROWS):
            out = defaultdict(list)
            known: dict[str, list[str]] = {}
            for t1, t2, text, item_text, item_id, n_items in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = known.get(text)
                if words is None:
                    known.clear()
                    words = known[text] = tokens(text)
                item_words = tokens(item_text)
                tiles = tile(words, item_words, least)
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * len(item_words):
                    for column, v in zip(names, (t1, t2, item_id, n_items, len(tiles), covered, len(item_words), covered / len(item_words)), strict=True):
                        out[column].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.float64() if n == "coverage" else pa.int64()) for n in names], names)

    names = [*TEXT, "item_id", "n_items", "n_tiles", "tiled_words", "item_words", "coverage"]
    found = both.select(*TEXT, "text", "item_text", "item_id", "n_items").mapInArrow(run, ", ".join(f"{n} {'double' if n == 'coverage' else 'long'}" for n in names))
    return cut(found, "tiles-found")


def contaminated_pairs(docs: DataFrame, bench: DataFrame, least: int = LEAST_TILE, coverage: float = COVERAGE) -> DataFrame:
    """One row for each row of docs(doc_id, text) and distinct item text of bench(item_id, text) with coverage at least `coverage`:
    doc_id, item_id, n_items, n_tiles, tiled_words, item_words, coverage.

    Words are Unicode word characters, lower-cased. Null, empty and wordless texts and items match nothing. Items of equal text are one, named
    by its smallest item_id, with their number as n_items; rows that repeat a document each have their own. Other columns are ignored.
    """
    found = tiled_texts(docs, bench, least, coverage)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key())
    return keyed.join(small_or_shuffled(found), TEXT).drop(*TEXT)


def drop_contaminated(docs: DataFrame, bench: DataFrame, least: int = LEAST_TILE, coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows that contaminated_pairs would name; all columns stay. Their texts move only if the table of contaminated texts is too large to broadcast."""
    bad = cut(tiled_texts(docs, bench, least, coverage).select(*TEXT).distinct(), "tiles-bad")
    bad = small_or_shuffled(bad.withColumnsRenamed({"t1": "_bad_t1", "t2": "_bad_t2"}))
    t1, t2 = F.xxhash64(docs["text"]), F.xxhash64(F.lit(1), docs["text"])
    return docs.join(bad, (t1 == bad["_bad_t1"]) & (t2 == bad["_bad_t2"]), "left_anti")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = table(spark, sf_dir, "documents")
    return contaminated_pairs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
