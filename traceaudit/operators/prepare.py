"""Task rows, prompts, splits, caps and mixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.functions.text import strip
from traceaudit.operators.ranks import grouped_rank

#: Values that the second dimension of missing_pairs has at most.
MOST_TASKS = 10_000


def to_task_rows(df: DataFrame, id_: Column, input_: Column, gt: Column, task: str, both_ways: str | None = None) -> DataFrame:
    """(id, input, gt, task); with both_ways also the swapped rows under that task name."""
    row = lambda a, b, t: df.select(id_.cast("string").alias("id"), a.alias("input"), b.alias("gt"), F.lit(t).alias("task"))
    out = row(input_, gt, task)
    return out.unionByName(row(gt, input_, both_ways)) if both_ways else out


def any_positive_label(cols: list[Column]) -> Column:
    """Yes if any is 1 or 1.0, No if some are given but none is, null if all are blank."""
    texts = F.array(*[c.cast("string") for c in cols])
    return F.when(F.exists(texts, lambda x: F.coalesce(x.isin("1", "1.0"), F.lit(False))), "Yes").when(F.exists(texts, lambda x: x.isNotNull() & (x != "")), "No")


def binary_label(c: Column, others_no: bool = False) -> Column:
    """1 is Yes and 0 is No, anything else null; with others_no all but 1 is No, null included."""
    t = c.cast("string")
    yes = F.when(F.coalesce(t.isin("1", "1.0"), F.lit(False)), "Yes")
    return yes.otherwise("No") if others_no else yes.when(t.isin("0", "0.0"), "No")


def tail_split(df: DataFrame, order: str, n: int, slices: int = 64) -> DataFrame:
    """split: the last n rows by order are test, the n before valid, the rest train.

    Only the 2n largest order values are ranked (top-k), and their bounds decide for all rows; order is a key.
    """
    top = df.select(order).orderBy(F.desc(order)).limit(2 * n)
    ranks = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(order))))  # at most 2n rows
    bounds = ranks.agg(F.min(F.when(F.col("_r") <= n, F.col(order))).alias("_test"), F.min(order).alias("_valid"))
    return df.join(F.broadcast(bounds)).withColumn("split", F.when(F.col(order) >= F.col("_test"), "test").when(F.col(order) >= F.col("_valid"), "valid").otherwise("train")).drop("_test", "_valid")


def split_pair(df: DataFrame, text: str, mark: str) -> DataFrame:
    """Rows whose text holds the mark, with left and right of its first place, without white space at their ends."""
    at = F.instr(text, F.lit(mark))
    return df.filter(F.col(text).contains(mark)).withColumn("left", strip(F.substring(F.col(text), F.lit(1), at - 1))).withColumn("right", strip(F.substring(F.col(text), at + len(mark), F.length(text))))


def pair_tasks(df: DataFrame, position: str, text: str, mark: str, forward: str, backward: str) -> DataFrame:
    """(id, input, gt, task) of the pairs in both directions. id is the row's position in its split, counted before rows without the mark drop out."""
    pairs = split_pair(df, text, mark)
    return to_task_rows(pairs, F.col(position), F.col("left"), F.col("right"), forward, backward)


def number_or_text(c: Column) -> Column:
    """struct(number, text): the value as a number, or as it stands where it is none; blanks are null in both."""
    t = F.when(strip(c.cast("string")) != "", c.cast("string"))
    return F.struct(t.try_cast("double").alias("number"), F.when(t.try_cast("double").isNull(), t).alias("text"))


def source_of(instruction: Column, pattern: str, fallback: Column) -> Column:
    """The first group of the pattern in the instruction, else the fallback."""
    return F.coalesce(F.nullif(F.regexp_extract(instruction, pattern, 1), F.lit("")), fallback)


def constraint_metadata(cols: dict[str, Column]) -> Column:
    """Map of the non-blank constraint columns, as text."""
    pairs = [x for k, c in cols.items() for x in (F.lit(k), c.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (strip(v) != ""))


def render_prompt(df: DataFrame, templates: dict[str, str], task: str, text: str) -> DataFrame:
    """prompt: the task's template with {input} replaced; null for a task without one."""
    picked = reduce(lambda rest, t: F.when(F.col(task) == t[0], F.lit(t[1])).otherwise(rest), templates.items(), F.lit(None).cast("string"))
    return df.withColumn("prompt", F.replace(picked, F.lit("{input}"), F.col(text)))


def build_messages(system: str, prompt: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def parse_constraints(instruction: Column, names: list[str]) -> Column:
    """Map name -> number from "<n> <name> atoms/bonds/groups"; the last mention of a name counts, other names do not."""
    found = F.transform(
        F.regexp_extract_all(instruction, F.lit(r"(?i)\d+ [a-z ]+? (?:atom|bond|group)s?\b"), 0),
        lambda m: F.struct(F.lower(F.regexp_extract(m, r"(?i)\d+ ([a-z ]+?) (?:atom|bond|group)", 1)).alias("name"), F.regexp_extract(m, r"^\d+", 0).cast("int").alias("n")),
    )
    kept = F.filter(found, lambda e: e["name"].isin(*names))
    return F.map_from_entries(F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["name"] == e["name"])))


def route_tasks(df: DataFrame, dimension: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the dimension's columns, rows whose key is unknown). The dimension is a short list of tasks and goes to the rows, as a shuffle would put all rows of a task into one partition."""
    return df.join(F.broadcast(dimension), key), df.join(F.broadcast(dimension.select(key)), key, "left_anti")


def filter_overlong(df: DataFrame, length: Column, most: int) -> DataFrame:
    return df.filter(length <= most)


def drop_unanswered(df: DataFrame, answer: str) -> DataFrame:
    return df.filter(F.col(answer).isNotNull() & (F.col(answer) != ""))


def select_models(df: DataFrame, column: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    df = df.filter(F.col(column).isin(include)) if include is not None else df
    return df.filter(~F.col(column).isin(exclude)) if exclude else df


def resolve_aliases(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """column replaced by the label of aliases(alias, label), left as it is without one."""
    names = aliases.groupBy("alias").agg(F.min("label").alias("_label"))
    return df.join(names, F.col(column) == F.col("alias"), "left").withColumn(column, F.coalesce("_label", column)).drop("alias", "_label")


def head_per_source(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """First n rows of each source by order (Spark keeps n per task before the shuffle)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(order))).filter(F.col("_r") <= n).drop("_r")


def cap_per_group(df: DataFrame, group: str, id_: str, cap: int, seed: int = 42) -> DataFrame:
    """At most cap rows of each group, those that come first by md5 of seed and id; small groups stay whole. Spark keeps cap rows per task and group before the shuffle."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_).cast("string")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(h, id_))).filter(F.col("_r") <= cap).drop("_r")


def every_kth(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """split: every k-th row of a group by order (a numeric key) is validation, the rest train."""
    return grouped_rank(df, group, order, "_r").withColumn("split", F.when(F.col("_r") % k == 0, "validation").otherwise("train")).drop("_r")


def mix_sources(parts: list[DataFrame], names: dict[str, str], task: str, id_: str, seed: int = 42) -> DataFrame:
    """Union with legacy task names replaced and a shuffle key (md5 of seed, task, id) that orders the mix."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    renamed = reduce(lambda rest, n: F.when(F.col(task) == n[0], F.lit(n[1])).otherwise(rest), names.items(), F.col(task))
    return out.withColumn(task, renamed).withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(task), F.col(id_).cast("string"))))


def missing_pairs(df: DataFrame, models: DataFrame, tasks: DataFrame, most: int = MOST_TASKS) -> DataFrame:
    """(model, task) of two dimensions that have no row. The tasks are one array, of at most `most` values (more raise an error), which each model unfolds."""
    (task,) = tasks.columns
    every = tasks.distinct().limit(most + 1).agg(F.collect_list(task).alias("_every"))
    if every.select(F.size("_every")).first()[0] > most:
        raise ValueError(f"more than {most} values of {task!r}")
    grid = models.join(F.broadcast(every)).select(*models.columns, F.explode("_every").alias(task))  # one row
    return grid.join(df.select(*grid.columns).distinct(), grid.columns, "left_anti")


def first_completion(df: DataFrame, keys: list[str], position: str, text: str) -> DataFrame:
    """One text per prompt: that of the first sample, '' where it is null."""
    return df.groupBy(*keys).agg(F.coalesce(F.min_by(text, position), F.lit("")).alias("answer"))


def training_rows(df: DataFrame, system: str, prompt: str, gt: str, task: str) -> DataFrame:
    """(problem, answer, task): system line and prompt, truth as JSON with its task."""
    return df.select(F.concat(F.lit(system + "\n"), F.col(prompt)).alias("problem"), F.to_json(F.struct(F.col(task).alias("task"), F.col(gt).alias("gt"))).alias("answer"), F.col(task).alias("task"))
