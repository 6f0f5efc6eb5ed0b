"""Exact nearest neighbours by a block matrix join with int8 tiles.

Vectors are normalised, quantised to int8 with one scale each, and packed into blocks that hold the codes, the error terms and the
original vectors. Groups of query blocks and groups of candidate blocks form a grid; each cell of it is a run of rows that a
task reads in order, its query blocks first, so a candidate travels once per group of queries and not once per tile. A tile is a
block of queries against a block of candidates. The product of the int8 blocks gives each cosine up to a bound that
follows from the residuals of both vectors, so a candidate whose upper bound lies below the k-th lower bound can't be
among the k nearest and is dropped; the rest is recomputed in double precision on the original vectors. Each cell
keeps one heap of k per query of its own, and the heaps of all cells meet in one small merge.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.llm.common import cut, in_runs

#: Vectors of a block, and blocks of a group, about.
CANDIDATES = 4096
QUERIES = 1024
CANDIDATE_BLOCKS = 64
QUERY_BLOCKS = 16
#: Surviving pairs that are recomputed at once.
PAIRS = 50_000
BLOCK = "block long, dim int, ids binary, codes binary, scales binary, residuals binary, norms binary, data binary"


def usable(df: DataFrame) -> DataFrame:
    """(id, v) of the vectors that take part: not null, without null or non-finite components, not all zero. An id that several rows have stands once, with
    the smallest of its vectors; only rows of such ids are grouped, so that vectors are not shuffled where ids are a key."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = df.filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").filter(F.coalesce(finite, F.lit(False))).filter(F.exists("v", lambda x: x != 0))
    good = good.select("id", F.col("v").cast("array<double>").alias("v"))
    many = cut(good.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "knn-repeated")
    return good.join(many, "id", "left_anti").union(good.join(many, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))


def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Pack (id, v) into rows of BLOCK: at most `rows` vectors of one dimension each, with a number that is drawn when the block is written.

    Each task fills blocks from its own rows; nothing is shuffled.
    """

    def pack(batches):
        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            ids, data = held.pop(dim)
            x = np.array(data, np.float64)
            codes, scales, residuals, norms = quantise(x)
            binary = [a.tobytes() for a in (np.array(ids, np.int64), codes, scales, residuals, norms, x)]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([dim], pa.int32()), *[pa.array([b], pa.binary()) for b in binary]], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, data = held.setdefault(len(v), ([], []))
                ids.append(i)
                data.append(v)
                if len(ids) == rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return cut(df.select("id", "v").mapInArrow(pack, BLOCK), name)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, normalised: int8 codes, scale, norm of the residual, norm of the coded vector."""
    unit = x / scaled_norm(x)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    coded = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(unit - coded, axis=1), np.linalg.norm(coded, axis=1)


def scaled_norm(x: np.ndarray) -> np.ndarray:
    """Euclidean norm of each row, without overflow or underflow in the squares."""
    top = np.abs(x).max(axis=1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision; equal vectors get equal values wherever they stand."""
    if not len(a):
        return np.empty(0)
    ta, tb = np.abs(a).max(axis=1)[:, None], np.abs(b).max(axis=1)[:, None]
    a, b = (a / ta, b / tb) if max(ta.max(), tb.max()) > 1e100 or min(ta.min(), tb.min()) < 1e-100 else (a, b)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows. Floats hold them exactly: 32 bits up to 1,000 dimensions, where sums stay below 2 ** 24."""
    kind = np.float32 if a.shape[1] <= 1000 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.float64)


def tile_survivors(q, c, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the pairs of a tile that may be among the k nearest. own: pairs to leave out; floor: k-th value known so far."""
    (qc, qs, qr, qn), (cc, cs, cr, cn) = q, c
    dots = products(qc, cc) * qs[:, None] * cs[None, :]
    bound = qr[:, None] * (cn + cr)[None, :] + qn[:, None] * cr[None, :] + 1e-9
    low = np.where(own, -np.inf, dots - bound)
    at = max(0, low.shape[1] - k)
    kth = np.partition(low, at, axis=1)[:, at] if low.shape[1] >= k else np.full(len(low), -np.inf)
    return np.nonzero(~own & (dots + bound >= np.maximum(kth, floor)[:, None]))


class Block:
    """A row of BLOCK as arrays."""

    def __init__(self, row: dict):
        self.dim, self.ids = row["dim"], np.frombuffer(row["ids"], np.int64)
        self.codes = (np.frombuffer(row["codes"], np.int8).reshape(-1, self.dim), *[np.frombuffer(row[c]) for c in ("scales", "residuals", "norms")])
        self.data = np.frombuffer(row["data"]).reshape(-1, self.dim)


class Heaps:
    """The k best (score, -id) of each query of a block."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.heaps: list[list] = [[] for _ in block.ids]
        self.floor = np.full(len(block.ids), -np.inf)

    def meet(self, other: Block) -> None:
        rows, cols = tile_survivors(self.block.codes, other.codes, self.block.ids[:, None] == other.ids[None, :], self.k, self.floor)
        for at in range(0, len(rows), PAIRS):
            r, c = rows[at : at + PAIRS], cols[at : at + PAIRS]
            scores = cosines(self.block.data[r], other.data[c])
            able = scores >= self.floor[r]
            for i, j, s in zip(r[able].tolist(), other.ids[c[able]].tolist(), scores[able].tolist(), strict=True):
                heap = self.heaps[i]
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, -j))
                elif (s, -j) > heap[0]:
                    heapq.heapreplace(heap, (s, -j))
                if len(heap) == self.k:
                    self.floor[i] = heap[0][0]

    def found(self) -> pa.RecordBatch:
        rows = [(int(i), -j, s) for i, heap in zip(self.block.ids, self.heaps, strict=True) for s, j in heap]
        ids, vecs, scores = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERIES, candidate_rows: int = CANDIDATES) -> DataFrame:
    """For each of queries(id, v) its k nearest of vectors(id, v) by cosine, itself (same id) left out: query_id, rank, vec_id, score.

    Exact: ties go to the smaller id, fewer rows come back where there are fewer candidates. Vectors of different length are never
    compared. An id that several rows have is one vector, the smallest of them (see usable). Each candidate block meets each query
    block once, so work grows with queries times vectors, in tiles of bounded size, and nothing is compared row by row in Spark.
    """
    cand = blocks(usable(vectors), candidate_rows, "knn-candidates")
    wanted = usable(queries)
    wanted = wanted.repartition(max(1, -(-wanted.count() // query_rows)))  # full blocks, for fewer tiles
    quer = blocks(wanted, query_rows, "knn-queries")
    q_groups = max(1, -(-quer.count() // QUERY_BLOCKS))
    n = cand.count()
    c_groups = max(1, -(-n // CANDIDATE_BLOCKS), min(n, -(-2 * cand.sparkSession.sparkContext.defaultParallelism // q_groups)))
    group = lambda groups: F.pmod("block", F.lit(groups)).cast("int")
    each = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    columns = [c.split()[0] for c in BLOCK.split(", ")]
    left = quer.withColumn("q_group", group(q_groups)).withColumn("c_group", each(c_groups)).select("q_group", "c_group", F.lit(0).alias("side"), *columns)
    right = cand.withColumn("c_group", group(c_groups)).withColumn("q_group", each(q_groups)).select("q_group", "c_group", F.lit(1).alias("side"), *columns)

    def search(batches):
        cell, heaps = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["q_group"], row["c_group"]) != cell:
                    yield from (h.found() for h in heaps)
                    cell, heaps = (row["q_group"], row["c_group"]), []
                block = Block(row)
                if row["side"] == 0:
                    heaps.append(Heaps(block, k))
                else:
                    for h in heaps:
                        if h.block.dim == block.dim:
                            h.meet(block)
        yield from (h.found() for h in heaps)

    cells = in_runs(left.union(right), ["q_group", "c_group"], ["q_group", "c_group", "side"])
    found = cells.mapInArrow(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_block_knn(spark, sf_dir: str) -> DataFrame:
    """Queries: vec_id divisible by 50; candidates: all embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(vectors, vectors.filter("id % 50 = 0"))
