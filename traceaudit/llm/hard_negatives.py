"""Hard negatives by bounds along spanning trees of anchors.

Vectors become whole numbers, so scores are exact. Anchors are packed into blocks of near ones, and each block has a minimum spanning
tree. A block of anchors meets a block of candidates level by level of its tree: the root's scores are computed; a child's score of
candidate v lies within its parent's score plus or minus |child - parent| * |v| (Cauchy-Schwarz). Only candidates whose interval reaches
into one of the child's windows are scored again, for the others the interval goes on to the child's own children. A window is a range of
scores that an anchor looks for, narrowed as soon as its k best are full. The first search has one window, everything, among rows of the anchor's
label: its positives. The second has a window for each positive, among rows of other labels: its hard negatives.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.llm.common import cut, in_runs

#: Vectors of a candidate block, anchors of a tree, and blocks of a group, about.
CANDIDATES = 4096
ANCHORS = 256
CANDIDATE_BLOCKS = 64
ANCHOR_BLOCKS = 32
#: Bytes of vectors of a block at most, which shortens blocks of very long vectors.
BLOCK_BYTES = 1 << 22
#: Anchors that others are dealt by, at most: a bounded sample that decides only which anchors share a tree, never a result.
PIVOTS = 128
#: The scale of components and the share of a positive's score, in hundredths, that a hard negative has at least.
SCALE, LOW_SHARE = 256, 80
#: Coded vectors of this norm and more take no part: their scores would not fit into a long.
MOST_NORM = float(2**31)
#: Up to this product of norms, scores are exact as doubles.
EXACT = float(2**53)
FAR = np.iinfo(np.int64).max
BLOCK = "block long, dim int, ids binary, labels binary, codes binary"
NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def usable(df: DataFrame) -> DataFrame:
    """(id, label, v array<long>) of the rows of df(id, label, v) that take part, components as floor(SCALE * x).

    Left out are rows with a null id, label or vector, with an empty vector, or with null or non-finite components, and vectors too long for scores of 64 bits.
    An id that several rows have stands once, with the smallest (label, vector); only rows of such ids are grouped.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = df.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0").filter(F.coalesce(finite, F.lit(False)))
    coded = F.transform("v", lambda x: F.lit(float(SCALE)) * x.cast("double"))
    good = good.select("id", F.col("label").cast("long").alias("label"), coded.alias("c"))
    good = good.filter(F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x)) + F.sqrt(F.size("c")) < MOST_NORM)
    good = good.select("id", "label", F.transform("c", lambda x: F.floor(x).cast("long")).alias("v"))
    many = cut(good.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "negatives-repeated")
    once = good.join(many, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    return good.join(many, "id", "left_anti").union(once)


def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Pack (id, label, v) into rows of BLOCK: at most `rows` vectors of one dimension each, in the order they come. Written; each task fills blocks from its own rows."""

    def pack(batches):
        held: dict[int, tuple[list, list, list]] = {}

        def out(dim):
            ids, labels, codes = (np.array(x, np.int64) for x in held.pop(dim))
            codes = codes.astype(np.result_type(np.min_scalar_type(min(-1, codes.min())), np.min_scalar_type(min(-1, -1 - codes.max()))))  # the narrowest that holds all
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([dim], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (ids, labels, codes)]], NAMES)

        for batch in batches:
            for i, label, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = held.setdefault(len(v), ([], [], []))
                for values, value in zip(x, (i, label, v), strict=True):
                    values.append(value)
                if len(x[0]) >= rows or 8 * len(x[0]) * len(v) >= BLOCK_BYTES:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return cut(df.select("id", "label", "v").mapInArrow(pack, BLOCK), name)


def near_blocks(anchors: DataFrame, rows: int) -> DataFrame:
    """Anchors packed with near ones: each goes to its nearest pivot, and blocks are filled in the order of pivots. Pivots are the `PIVOTS` anchors whose ids come first in
    hash order; they reach the driver and every task, and where they lie badly the trees have longer edges, nothing else."""
    anchors = cut(anchors, "negatives-anchors")
    pivots: dict[int, list] = {}
    for r in anchors.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect():
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    tables = {dim: np.array(v, np.float64) for dim, v in pivots.items()}

    def deal(batches):
        for batch in batches:
            vectors, found = batch.column(2).to_pylist(), []
            for v in vectors:
                p = tables.get(len(v))
                found.append(-1 if p is None else int(np.argmin(((p - np.array(v, np.float64)) ** 2).sum(axis=1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], ["id", "label", "v", "pivot"])

    dealt = anchors.mapInArrow(deal, "id long, label long, v array<long>, pivot int").withColumn("dim", F.size("v"))
    n = max(1, -(-anchors.count() // rows))
    return blocks(dealt.repartitionByRange(n, "dim", "pivot", "id").sortWithinPartitions("dim", "pivot", "id"), rows, "negatives-trees")


def spanning_tree(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Levels (arrays of row numbers, the root alone first), parents and edge lengths of the minimum spanning tree of the rows, grown from the row nearest to their mean."""
    x = x.astype(np.float64)
    root = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    parent, edge, depth = np.full(len(x), root), np.linalg.norm(x - x[root], axis=1), np.zeros(len(x), np.int64)
    out = np.ones(len(x), bool)
    out[root], edge[root] = False, 0.0
    best = np.where(out, edge, np.inf)
    for _ in range(len(x) - 1):
        i = int(np.argmin(best))
        out[i], best[i] = False, np.inf
        edge[i] = np.linalg.norm(x[i] - x[parent[i]])
        depth[i] = depth[parent[i]] + 1
        d = np.linalg.norm(x - x[i], axis=1)
        nearer = out & (d < best)
        parent[nearer], best[nearer] = i, d[nearer]
    return [np.flatnonzero(depth == n) for n in range(int(depth.max()) + 1)], parent, edge


class Block:
    """A row of BLOCK as arrays."""

    def __init__(self, row: dict):
        self.dim, self.ids, self.labels = row["dim"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        width = len(row["codes"]) // (len(self.ids) * self.dim)
        self.codes = np.frombuffer(row["codes"], f"i{width}").reshape(-1, self.dim).astype(np.int64)
        self.floats = self.codes.astype(np.float64)
        self.norms = np.linalg.norm(self.floats, axis=1)


class Tree:
    """A block of anchors with its tree, its windows and the k best rows of each window so far."""

    def __init__(self, block: Block, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.block, self.k, self.same = block, k, same
        self.levels, self.parent, self.edge = spanning_tree(block.codes)
        self.low, self.high = low, high  # anchors x windows; an empty window has low > high
        self.scores = np.full((*low.shape, k), -FAR)
        self.ids = np.full((*low.shape, k), FAR)
        self.rescored = self.seen = 0

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score that still counts for each anchor: a window's floor rises to its k-th best."""
        some = self.low <= self.high
        return np.where(some, np.maximum(self.low, self.scores[:, :, -1]), FAR).min(axis=1), np.where(some, self.high, -FAR).max(axis=1)

    def meet(self, other: Block) -> None:
        """All candidates of a block, along the tree."""
        b, wide = self.block, float(self.block.norms.max()) * float(other.norms.max()) >= EXACT
        kind = "codes" if wide else "floats"
        a, c = getattr(b, kind), getattr(other, kind)
        least, most = np.empty((len(b.ids), len(c))), np.empty((len(b.ids), len(c)))
        floor, top = self.reach()
        self.seen += least.size
        for level, nodes in enumerate(self.levels):
            if level:
                room = (self.edge[nodes][:, None] * (1 + 1e-9) + 1e-9 * b.norms.max()) * other.norms[None, :] + 1
                least[nodes], most[nodes] = least[self.parent[nodes]] - room, most[self.parent[nodes]] + room
                want = (most[nodes] >= floor[nodes][:, None]) & (least[nodes] <= top[nodes][:, None])
            else:
                want = np.ones((1, len(c)), bool)
            at, col = np.nonzero(want)
            self.rescored += len(at)
            if not len(at):
                continue
            if 8 * len(at) >= want.size:
                scores = (a[nodes] @ c.T)[at, col]
            else:
                scores = np.concatenate([(a[nodes[i]] * c[j]).sum(axis=1) for i, j in zip(*(np.array_split(x, -(-len(at) // 50_000)) for x in (at, col)), strict=True)])
            rows = nodes[at]
            least[rows, col] = most[rows, col] = scores
            scores = scores.astype(np.int64)
            fit = (scores >= floor[rows]) & (scores <= top[rows]) & ((b.labels[rows] == other.labels[col]) == self.same) & (b.ids[rows] != other.ids[col])
            self.keep(rows[fit], other.ids[col[fit]], scores[fit])

    def keep(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge scored rows into the k best of each window."""
        for w in range(self.low.shape[1]):
            fit = (scores >= np.maximum(self.low[rows, w], self.scores[rows, w, -1])) & (scores <= self.high[rows, w])
            if not fit.any():
                continue
            touched = np.unique(rows[fit])
            r = np.concatenate([rows[fit], np.repeat(touched, self.k)])
            i = np.concatenate([ids[fit], self.ids[touched, w].ravel()])
            s = np.concatenate([scores[fit], self.scores[touched, w].ravel()])
            order = np.lexsort((i, -s, r))
            r, i, s = r[order], i[order], s[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            first = rank < self.k
            self.ids[r[first], w, rank[first]], self.scores[r[first], w, rank[first]] = i[first], s[first]

    def found(self) -> pa.RecordBatch:
        """(anchor_id, slot, vec_id, score): the best of each window in this cell."""
        a, w, n = np.nonzero(self.ids != FAR)
        return pa.RecordBatch.from_arrays([pa.array(self.block.ids[a]), pa.array(w, pa.int32()), pa.array(self.ids[a, w, n]), pa.array(self.scores[a, w, n])], ["anchor_id", "slot", "vec_id", "score"])


def search(trees: DataFrame, candidates: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, rank, vec_id, score): the first k candidates, by score and then smaller id, of each window of each anchor.

    trees: rows of BLOCK with `low` and `high`, the windows of its anchors (binary, anchors x windows). Groups of trees and groups of candidate blocks form a grid, whose
    cells are runs of rows that a task reads in order, trees first; the results of the cells meet in one small merge.
    """
    n_trees, n = trees.count(), candidates.count()
    t_groups = max(1, -(-n_trees // ANCHOR_BLOCKS))
    c_groups = max(1, -(-n // CANDIDATE_BLOCKS), min(n, -(-2 * candidates.sparkSession.sparkContext.defaultParallelism // t_groups)))
    group = lambda groups: F.pmod("block", F.lit(groups)).cast("int")
    each = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    none = F.lit(None).cast("binary")
    left = trees.withColumn("t_group", group(t_groups)).withColumn("c_group", each(c_groups)).select("t_group", "c_group", F.lit(0).alias("side"), *NAMES, "low", "high")
    right = candidates.withColumn("c_group", group(c_groups)).withColumn("t_group", each(t_groups)).select("t_group", "c_group", F.lit(1).alias("side"), *NAMES, none.alias("low"), none.alias("high"))

    def run(batches):
        cell, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["t_group"], row["c_group"]) != cell:
                    yield from (t.found() for t in held)
                    cell, held = (row["t_group"], row["c_group"]), []
                block = Block(row)
                if row["side"] == 0:
                    low, high = (np.frombuffer(row[x], np.int64).reshape(len(block.ids), -1) for x in ("low", "high"))
                    held.append(Tree(block, low, high, k, same))
                else:
                    for t in held:
                        if t.block.dim == block.dim:
                            t.meet(block)
        yield from (t.found() for t in held)

    cells = in_runs(left.union(right), ["t_group", "c_group"], ["t_group", "c_group", "side"])
    found = cells.mapInArrow(run, "anchor_id long, slot int, vec_id long, score long")
    w = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def everything(trees: DataFrame) -> DataFrame:
    """trees with one window for each anchor that any score lies in."""
    size = (F.length("ids") / 8).cast("int")
    return trees.withColumns({c: F.unhex(F.repeat(F.lit(int(v).to_bytes(8, "little", signed=True).hex()), size)) for c, v in (("low", -FAR), ("high", FAR))})


def windows(trees: DataFrame, positives: DataFrame, slots: int, share: int) -> DataFrame:
    """trees with a window for each positive(anchor_id, slot, score) of its anchors: share * score <= 100 * x <= 100 * score. Absent ones are empty.

    A block gathers `slots` short rows for each of its anchors.
    """

    def members(batches):
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids), pa.array(np.arange(len(ids), dtype=np.int32))], ["block", "anchor_id", "place"])

    def fill(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.select(["ids", "found"]).to_pylist()[0]
                low, high = np.full((len(row["ids"]) // 8, slots), FAR), np.full((len(row["ids"]) // 8, slots), -FAR)
                for x in row["found"] or ():
                    low[x["place"], x["slot"]], high[x["place"], x["slot"]] = -(-share * x["score"] // 100), x["score"]
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in NAMES], pa.array([low.tobytes()], pa.binary()), pa.array([high.tobytes()], pa.binary())], [*NAMES, "low", "high"])

    places = trees.select("block", "ids").mapInArrow(members, "block long, anchor_id long, place int")
    found = places.join(positives, "anchor_id").groupBy("block").agg(F.collect_list(F.struct("place", "slot", "score")).alias("found"))
    return cut(trees.join(found, "block", "left").mapInArrow(fill, f"{BLOCK}, low binary, high binary"), "negatives-windows")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: int = LOW_SHARE) -> DataFrame:
    """Hard negatives of the rows(id, label, v) where is_anchor holds: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are products of vectors as whole numbers; higher ones come first, ties go to the smaller id. An anchor's positives are the first `positives` other rows of its
    label; for each of them come the first `negatives` rows of other labels whose score lies between share hundredths of the positive's and the positive's own.
    Exact: rows are left out only where a bound proves that they can't be among these. An anchor without positives, or a positive without negatives, gives
    no rows; vectors of different length are never compared; see usable for the rows that take part.
    """
    rows = usable(rows)
    candidates = blocks(rows, CANDIDATES, "negatives-candidates")
    trees = near_blocks(rows.filter(is_anchor), ANCHORS)
    near = search(everything(trees), candidates, positives, same=True)
    near = cut(near.select("anchor_id", (F.col("rank") - 1).alias("slot"), "vec_id", "score"), "negatives-positives")
    hard = search(windows(trees, near, positives, share), candidates, negatives, same=False)
    near = near.select("anchor_id", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(near, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors: vec_id divisible by 100; rows: all embeddings, those with a vec_id divisible by 7 under the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("v"))
    return mine(rows, F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.id AS a, c.id AS c, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.id % 100 = 0 AND a.id <> c.id),
p AS (SELECT a, c AS positive, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5)
SELECT p.a AS anchor_id, p.positive AS positive_id, (row_number() OVER w)::INT AS rank, s.c AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.a, p.positive ORDER BY s.score DESC, s.c) QUALIFY row_number() OVER w <= 5
"""
