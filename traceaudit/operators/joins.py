"""Joins on (model, task, id): assembling records, what is pending, record differences, facts, intervals, donors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["model", "task", "id"]


def assemble(verdicts: DataFrame, responses: DataFrame, metadata: DataFrame | None = None, keys: list[str] = KEY) -> DataFrame:
    """verdicts left-joined with responses and, where a record's own map is null or empty, with the metadata of the side table."""
    out = verdicts.join(responses, keys, "left")
    if metadata is None:
        return out
    own = F.col("metadata")
    side = metadata.select(*keys, F.col("metadata").alias("_side"))
    return out.join(side, keys, "left").withColumn("metadata", F.coalesce(F.when(F.size(own) > 0, own), F.col("_side"))).drop("_side")


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys), keys, "left_anti")


def diff_records(fresh: DataFrame, shipped: DataFrame, keys: list[str], fields: list[str], by: list[str]) -> DataFrame:
    """Per `by`: n_same, n_differing, only_fresh, only_shipped, first_field (of the smallest differing key), passed (something compared and nothing differs)."""
    a = fresh.select(*keys, F.struct(*fields).alias("a"))
    b = shipped.select(*keys, F.struct(*fields).alias("b"))
    both = a.join(b, keys, "full")
    field = F.coalesce(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields])
    rows = both.withColumn("kind", F.when(F.col("b").isNull(), "only_fresh").when(F.col("a").isNull(), "only_shipped").when(field.isNotNull(), "differing").otherwise("same")).withColumn("field", F.when(F.col("kind") == "differing", field))
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    rest = [k for k in keys if k not in by]
    return rows.groupBy(*by).agg(
        n("same").alias("n_same"),
        n("differing").alias("n_differing"),
        n("only_fresh").alias("only_fresh"),
        n("only_shipped").alias("only_shipped"),
        F.min(F.when(F.col("kind") == "differing", F.struct(*rest, "field")))["field"].alias("first_field"),
        ((n("same") > 0) & (n("differing") == 0)).alias("passed"),
    )


def facts_join(df: DataFrame, facts: DataFrame, key: str, prefix: str = "fact_") -> DataFrame:
    """df with the columns of facts(key, ...) prefixed; strings without facts keep nulls. Facts are one row per key; Spark splits a hot key."""
    renamed = facts.select(F.col("key").alias(key), *[F.col(c).alias(prefix + c) for c in facts.columns if c != "key"])
    return df.join(renamed, key, "left")


def tokens_in_spans(tokens: DataFrame, spans: DataFrame, doc: str = "doc", width: int = 256) -> DataFrame:
    """tokens(doc, char_start, char_end, ...) that lie wholly inside spans(doc, lo, hi, span), one row per token and span; empty tokens are left out.

    A range join by bins. Spans of up to `width` characters share bins of that width, those of up to twice as many bins of twice the width, and so on; a span is
    one row for each of the two bins of its level, at most, that it touches, and a token one row for each level that has spans, in the bin where it begins. The two meet by
    (doc, level, bin), so a document of very many tokens is many keys and tokens meet spans near them alone: rows that are shuffled are in proportion
    to tokens and spans. Nulls in bounds match nothing.
    """
    at, level = (next(n for n in (f"{u}{name}" for u in ("_", "__", "___")) if n not in {*tokens.columns, *spans.columns}) for name in ("bin", "level"))
    bin_of = lambda c: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(2.0), F.col(level)))).cast("long")
    length = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    whole = spans.filter(F.col("lo") <= F.col("hi")).withColumn(level, F.greatest(F.lit(0), F.ceil(F.log2(length / width))).cast("int"))
    levels = sorted(r[0] for r in whole.select(level).distinct().collect())  # at most as many as a length has bits
    binned = whole.withColumn(at, F.explode(F.sequence(bin_of("lo"), bin_of("hi"))))
    levels = F.array(*[F.lit(n) for n in levels]).cast("array<int>")
    placed = tokens.filter(F.col("char_end") > F.col("char_start")).withColumn(level, F.explode(levels)).withColumn(at, bin_of("char_start"))
    return placed.join(binned, [doc, level, at]).filter((F.col("char_start") >= F.col("lo")) & (F.col("char_end") <= F.col("hi"))).drop(at, level)


def region_of(flags: dict[str, Column]) -> Column:
    """answer before trace before input, else other."""
    return F.when(flags["answer"], "answer").when(flags["trace"], "trace").when(flags["input"], "input").otherwise("other")


def pair_donor(df: DataFrame, task: str, uid: str, text: str, slices: int = 64) -> DataFrame:
    """(uid, donor, donor_text): the next response of the task in md5 order whose text differs, at most two steps on, cyclic; absent otherwise.

    Ranks come from counts per (task, slice of the order) plus a rank inside the slice, so that a task with a third of all rows
    is spread over `slices` windows. Ranks and comparisons take hashes of the texts; only the donors' texts are fetched, in one join at the end.
    (task, uid) is a key.
    """
    h = F.md5(F.concat_ws("|", F.col(task), F.col(uid).cast("string")))
    keyed = df.select(task, uid, F.md5(text).alias("same"), h.alias("h")).withColumn("slice", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * slices / (1 << 32)).cast("int"))
    counts = keyed.groupBy(task, "slice").agg(F.count("*").alias("c"))
    before = Window.partitionBy(task).orderBy("slice")
    starts = counts.withColumn("start", F.sum("c").over(before) - F.col("c")).withColumn("total", F.sum("c").over(Window.partitionBy(task))).drop("c")
    ranked = keyed.join(starts, [task, "slice"]).withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy(task, "slice").orderBy("h", uid)) - 1)
    out = ranked.select(task, uid, "same", "rank", "total")
    for step in (1, 2):
        donor = ranked.select(task, F.col("rank").alias(f"r{step}"), F.col(uid).alias(f"u{step}"), F.col("same").alias(f"s{step}"))
        out = out.withColumn(f"r{step}", F.pmod(F.col("rank") + step, F.col("total"))).join(donor, [task, f"r{step}"], "left")
    pick = F.when(F.col("s1") != F.col("same"), F.col("u1")).when(F.col("s2") != F.col("same"), F.col("u2"))
    chosen = out.select(F.col(task).alias("_task"), uid, pick.alias("donor")).filter("donor IS NOT NULL")
    texts = df.select(F.col(task).alias("_task"), F.col(uid).alias("donor"), F.col(text).alias("donor_text"))
    return chosen.join(texts, ["_task", "donor"]).select(uid, "donor", "donor_text")


def exact_by_facts(df: DataFrame, facts: DataFrame, predicted: str, truth: str) -> DataFrame:
    """df with exact: whether the canonical forms of both strings in facts(key, canonical) are the same; a string without facts stands for itself."""
    canonical = facts.select("key", "canonical")
    rows = facts_join(facts_join(df, canonical, predicted, "_p_"), canonical, truth, "_t_")
    same = F.coalesce("_p_canonical", predicted) == F.coalesce("_t_canonical", truth)
    return rows.withColumn("exact", F.coalesce(same, F.lit(False))).drop("_p_canonical", "_t_canonical")


def set_counts_by_facts(df: DataFrame, facts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Per keys, over rows of one part each: parts, and valid_parts, those that facts(key, valid) call valid."""
    rows = facts_join(df, facts.select("key", "valid"), part, "_")
    return rows.groupBy(*keys).agg(F.count("*").alias("parts"), F.count(F.when(F.col("_valid"), 1)).alias("valid_parts"))


def against_base(df: DataFrame, uid: str, cond: str, value: str, base: str) -> DataFrame:
    """Rows of the other conditions with the value of the same uid's base row; uids without a base row drop out."""
    bases = df.filter(F.col(cond) == base).select(uid, F.col(value).alias("base_value"))
    return df.filter(F.col(cond) != base).join(bases, uid)
