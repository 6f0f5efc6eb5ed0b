"""How filters interact, from sorted posting lists of the rows that fail them.

Every row has a number. For each part of the table (a language, say) and each range of row numbers, each filter has the sorted list of
the rows that fail it, and each mark (good, toxic) the list of the rows that carry it. Within such a cell galloping k-way merges give
the union of any set of filters and what one more filter would add to it; the sizes of these lists are summed over the ranges. An
order of filters is a walk through these sets, so all orders of all parts come from the same few sums. A cell is bounded by the width
of a range, so a part with most of the rows is many cells.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.llm.common import cut, new_names, pieces_of
from traceaudit.session import table

#: Row numbers of a range: at most so many ids in a list.
WIDTH = 1 << 16
ROWS = 64
#: Texts as frequent as one in so many are looked up in a broadcast table, which has so many rows at most; rarer ones are joined by a shuffle.
HOT_SHARE = 1_000
FILTERS = "ABCDE"
#: Upper-case letters and characters that filter D looks for.
UPPER, SPECIAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*|"


def gallop(ids: Sequence[int], at: int, least: int) -> int:
    """The first place from `at` on whose id is at least `least`: steps of doubling length, then a binary search inside the last."""
    step, n = 1, len(ids)
    if at >= n or ids[at] >= least:
        return at
    while at + step < n and ids[at + step] < least:
        at += step
        step *= 2
    return bisect_left(ids, least, at + 1, min(n, at + step))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """Sorted ids that stand in any of the sorted lists. The list with the smallest head gives all ids below the next head at once."""
    heads = [[ids, 0] for ids in lists if ids]
    out: list[int] = []
    while len(heads) > 1:
        heads.sort(key=lambda h: h[0][h[1]])
        ids, at = heads[0]
        other, other_at = heads[1]
        least = other[other_at]
        to = gallop(ids, at, least)
        out += ids[at:to]
        if to < len(ids) and ids[to] == least:  # the other list gives it
            to += 1
        heads[0][1] = to
        if to == len(ids):
            heads.pop(0)
    for ids, at in heads:
        out += ids[at:]
    return out


def difference(ids: Sequence[int], other: Sequence[int]) -> list[int]:
    """Sorted ids that do not stand in the sorted list `other`."""
    out: list[int] = []
    at = there = 0
    while at < len(ids) and there < len(other):
        to = gallop(ids, at, other[there])
        out += ids[at:to]
        if to == len(ids):
            return out
        at = to + (ids[to] == other[there])
        if at < len(ids):
            there = gallop(other, there, ids[at])
    out += ids[at:]
    return out


def shared(ids: Sequence[int], other: Sequence[int]) -> int:
    """How many ids stand in both sorted lists."""
    return len(ids) - len(difference(ids, other)) if len(ids) <= len(other) else len(other) - len(difference(other, ids))


def postings(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(part, range, list, ids): the sorted row numbers of each list by part and range, from rows(part, row, lists array<string>).

    A row stands in each list that it names. A range has at most `width` row numbers, which bounds every group.
    """
    at = F.floor(F.col("row") / width).cast("long").alias("range")
    return rows.select("part", at, "row", F.explode("lists").alias("list")).groupBy("part", "range", "list").agg(F.sort_array(F.collect_list("row")).alias("ids"))


def additions(lists: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """(part, before, filter, failing, removed, <mark>_lost...) from postings: for each set of filters that ran before (bits in the order of
    `filters`) and each other filter, how many rows fail it and how many of these nothing before has removed, all and by mark. Sums over all ranges; sets and filters
    without failing rows in a part may be absent."""
    kinds = ["failing", "removed", *[f"{m}_lost" for m in marks]]

    def run(batches):
        for batch in pieces_of(batches, 1):
            row = batch.to_pylist()[0]
            have = dict(zip((x["list"] for x in row["lists"]), (x["ids"] for x in row["lists"]), strict=True))
            failing = [have.get(f, []) for f in filters]
            out = []
            for before in range(1 << len(filters)):
                gone = union([ids for i, ids in enumerate(failing) if before >> i & 1])
                for i, ids in enumerate(failing):
                    if ids and not before >> i & 1:
                        new = difference(ids, gone)
                        out.append((row["part"], before, filters[i], len(ids), len(new), *[shared(new, have.get(m, [])) for m in marks]))
            columns = list(zip(*out, strict=True)) or [[] for _ in range(3 + len(kinds))]
            types = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "before", "filter", *kinds])

    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # merges are work out of proportion to the bytes of their lists, so small lists are not put together in few tasks
    cells = lists.repartition(tasks, "part", "range").groupBy("part", "range").agg(F.collect_list(F.struct("list", "ids")).alias("lists"))  # one row for each list: filters and marks, a handful
    found = cells.select("part", "lists").mapInArrow(run, "part string, before int, filter string, " + ", ".join(f"{k} long" for k in kinds))
    return found.groupBy("part", "before", "filter").agg(*[F.sum(k).alias(k) for k in kinds])


def steps(filters: Sequence[str]) -> list[tuple[str, int, str, int]]:
    """(filter_order, step, filter, before) of all orders of the filters."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    return [("".join(order), n + 1, f, sum(bit[g] for g in order[:n])) for order in permutations(filters) for n, f in enumerate(order)]


def audit(rows: DataFrame, filters: Sequence[str] = FILTERS, marks: Sequence[str] = ("good", "toxic"), width: int = WIDTH) -> DataFrame:
    """One row for each part of rows(part, row, lists), order of the filters and step; see op12_filter_audit for the counts.

    row: a number of its own for each row; lists: the filters that it fails and the marks that it carries. rows is read twice, so it should be a
    written table. All orders of n filters are n! * n rows a part, so this is for a handful of filters.
    """
    n = len(filters)
    added = cut(additions(postings(rows, width), filters, marks), "audit-added")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    whole = added.groupBy("part", "filter").agg(
        F.max("failing").alias("failing"),
        F.sum(F.when(F.bit_count("before") == n - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).alias("shapley"),
    )
    order = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("filter"), F.lit(b).alias("before")) for o, s, f, b in steps(filters)]))
    plan = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", "n", order.alias("o")).select("part", "n", "o.*")
    lost = [f"{m}_lost" for m in marks]
    one = plan.join(added.drop("failing"), ["part", "before", "filter"], "left").join(whole, ["part", "filter"], "left")
    zero = one.select("part", "n", "filter_order", "step", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("removed", "failing", "unique_fails", *lost, "shapley")])
    gone = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return zero.select("part", "filter_order", "step", (F.col("n") - gone).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley")


def text_failures(docs: DataFrame, part: Column) -> DataFrame:
    """(row, part, doc_id, fails array<string>, digest) of each row of docs(doc_id, text, ...): filters A to D by the text, and the SHA-256 of the text. Written."""
    (name,) = new_names(docs, "part")

    def run(batches):
        for batch in pieces_of(batches, ROWS):
            fails, digests = [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                data = text.encode("utf-8", "surrogatepass")
                words = data.split()
                found = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum(map(text.count, UPPER)) > 10 * len(text), any(c in text for c in SPECIAL))
                fails.append([f for f, bad in zip(FILTERS, found, strict=False) if bad])
                digests.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fails, pa.list_(pa.string())), pa.array(digests, pa.binary())], ["part", "doc_id", "fails", "digest"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    out = docs.withColumn(name, part).select(F.col(name).alias("part"), "doc_id", "text").mapInArrow(run, f"part string, doc_id {ids}, fails array<string>, digest binary")
    return cut(out.withColumn("row", F.monotonically_increasing_id()), "audit-texts")


def first_ids(rows: DataFrame) -> DataFrame:
    """rows(doc_id, digest, ...) with `first`, the smallest doc_id of the rows with that digest, or null where only one row has it.

    Counts are gathered before the shuffle. Digests of more than a thousandth of all rows, of which there are at most a thousand, are looked up in a
    broadcast table, the others joined by a shuffle in which no key has more rows than that.
    """
    counted = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    counted = cut(counted, "audit-repeated")
    hot = F.col("n") > max(HOT_SHARE, rows.count() // HOT_SHARE)
    common = rows.join(F.broadcast(counted.filter(hot).select("digest", "first", F.lit(True).alias("known"))), "digest", "left")
    done = common.filter("known").drop("known")
    rest = common.filter("known IS NULL").drop("known", "first").join(counted.filter(~hot).select("digest", "first"), "digest", "left")
    return done.unionByName(rest)


def failing_rows(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """(part, row, lists): the filters A to E that each row of docs fails, and the marks good and toxic of its labels; written. A row's E compares with all rows
    of a smaller doc_id, whatever their part; a row without an id is identical to no smaller one. An id is good (toxic) where any of its labels says so."""
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = cut(known.filter("good OR toxic"), "audit-labels")
    rows = first_ids(text_failures(docs, part)).join(known, "doc_id", "left")
    marks = F.array(F.when(F.col("first") < F.col("doc_id"), F.lit("E")), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic")))
    return cut(rows.select("part", "row", F.concat("fails", F.array_compact(marks)).alias("lists")), "audit-rows")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All documents by language, five filters, all 120 orders.

    Counts within the part, of rows: kept (after this step), removed (here), redundant (fail its filter, removed earlier), unique_fails (fail its filter only),
    good_lost and toxic_lost (removed here, labelled so), shapley (removed by its filter, summed over all orders). An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return audit(failing_rows(docs, table(spark, sf_dir, "labels"), F.coalesce("lang", F.lit(""))))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, (len(w) < 100)::INT + 2 * (100 * coalesce(u.n, 0) < 80 * len(w))::INT
      + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
      + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN u USING (r) LEFT JOIN l USING (doc_id)),
p AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
o AS (
  SELECT '' AS filter_order, 0 AS step, '' AS f, 0 AS bit, 0 AS before
  UNION ALL SELECT filter_order || c, step + 1, c, b, before + bit FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b) WHERE NOT contains(filter_order, c)),
s AS (
  SELECT full_order.filter_order, o.step, o.f, o.bit, o.before
  FROM o JOIN (SELECT filter_order FROM o WHERE step = 5) full_order ON o.step > 0 AND starts_with(full_order.filter_order, o.filter_order)),
c AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM p, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM c
"""
