"""Perturbed traces: which claim to corrupt, the corrupted texts, and one row per condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.text import once

Lexicon = dict[str, tuple[str, ...]]


def present_keyword(text: Column, keywords: tuple[str, ...]) -> Column:
    """The longest keyword (then the first by name) that occurs as a substring, any case; null if none does."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(k.lower()), F.lit(k)) for k in sorted(keywords, key=lambda k: (-len(k), k))])


def _words(keywords: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(k) for k in sorted(keywords, key=lambda k: (-len(k), k))])


def choose_target(trace: Column, lexicon: Lexicon, generic=(), prefer_in: Column | None = None) -> Column:
    """struct(group, keyword) of the first specific group, in lexicon order, with a keyword in the trace; with prefer_in, one that is also in that text comes first."""
    options = F.array(*[F.struct(F.lit(g).alias("group"), _words(w).alias("words")) for g, w in lexicon.items() if g not in generic])

    def in_text(low: Column) -> Column:
        found = F.transform(options, lambda o: F.struct(o["group"].alias("group"), F.get(F.filter(o["words"], lambda w: low.contains(F.lower(w))), F.lit(0)).alias("keyword")))
        return F.filter(found, lambda o: o["keyword"].isNotNull())

    named = once(F.lower(trace), in_text)
    if prefer_in is None:
        return F.get(named, F.lit(0))
    also = lambda low: once(named, lambda n: F.coalesce(F.get(F.filter(n, lambda o: low.contains(F.lower(o["keyword"]))), F.lit(0)), F.get(n, F.lit(0))))
    return once(F.lower(prefer_in), also)


def with_target(df: DataFrame, target: Column, column: str = "t") -> DataFrame:
    """Rows that have a target, with it in a column. (As a generated row, so that it is chosen once and not again by the filter and by each reader.)"""
    return df.select("*", F.explode(F.array_compact(F.array(target))).alias(column))


def replace_first(text: Column, old: Column, new: Column, low: Column | None = None) -> Column:
    """The first occurrence of old, any case, replaced; the text itself without one. low: the lower-cased text, if it is there already."""
    put = lambda at: F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)
    return once(F.instr(F.lower(text) if low is None else low, F.lower(old)), put)


def other_group_keyword(group: Column, key: Column, lexicon: Lexicon) -> Column:
    """First keyword of another group, chosen by md5 of the key, never by chance."""
    groups = list(lexicon)
    n = len(groups)
    shift = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % (n - 1) + 1
    at = F.array_position(F.array(*[F.lit(g) for g in groups]), group) - 1
    firsts = F.array(*[F.lit(lexicon[g][0]) for g in groups])
    return F.get(firsts, ((at + shift) % n).cast("int"))


def synonym(group: Column, keyword: Column, lexicon: Lexicon) -> Column:
    """Another keyword of the same group, null if it has only one."""
    out = F.lit(None).cast("string")
    for g, words in lexicon.items():
        alternatives = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: w != keyword)
        out = F.when(group == g, F.get(alternatives, 0)).otherwise(out)
    return out


def corrupt_all(text: Column, lexicon: Lexicon, replacement: str) -> Column:
    """First keyword occurrence of every present group replaced, in lexicon order."""
    groups = F.array(*[_words(w) for w in lexicon.values()])
    both = lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"))

    def one(s: Column, words: Column) -> Column:
        keyword = F.get(F.filter(words, lambda w: s["low"].contains(F.lower(w))), F.lit(0))
        return once(keyword, lambda k: F.when(k.isNull(), s).otherwise(once(replace_first(s["text"], k, F.lit(replacement), s["low"]), both)))

    return F.aggregate(groups, once(text, both), one, lambda s: s["text"])


def drop_trace(answer: Column) -> Column:
    """The trace emptied, its tags kept."""
    return F.regexp_replace(answer, r"(?s)<think>.*?</think>", "<think></think>")


def swap_trace(answer: Column, donor: Column) -> Column:
    """The donor's text in place of the trace; null without donor or trace."""
    start, end = F.instr(answer, F.lit("<think>")), F.instr(answer, F.lit("</think>"))
    return F.when(donor.isNotNull() & (start > 0) & (end > start), F.concat(F.substring(answer, F.lit(1), start + 6), donor, F.substring(answer, end, F.length(answer))))


def mask_fragments(text: Column, fragments: Column, mask: str = "[...]") -> Column:
    """Every fragment replaced everywhere, longest first."""
    order = F.array_sort(F.array_distinct(fragments), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(order, text, lambda t, f: F.replace(t, f, F.lit(mask)))


def corrupt_fragments(df: DataFrame, key: str, text: str, fragments: Column, pool: DataFrame, column: str = "corrupted") -> DataFrame:
    """Every distinct fragment of a text replaced by another valid entry of pool(key), picked by the md5 of the fragment; texts without fragments stay.

    The pool is numbered by md5 order in slices, fragments meet it in an equi-join on the number, and only (key, fragment, substitute) rows travel.
    """
    from pyspark.sql import Window

    n = pool.agg(F.count("*").alias("n"))
    slices = F.pmod(F.xxhash64("key"), F.lit(64))
    sizes = pool.groupBy(slices.alias("s")).agg(F.count("*").alias("c")).withColumn("start", F.sum("c").over(Window.orderBy("s")) - F.col("c"))  # at most 64 rows
    ranked = pool.select("key", slices.alias("s")).join(F.broadcast(sizes), "s").select(F.col("key").alias("substitute"), (F.col("start") + F.row_number().over(Window.partitionBy("s").orderBy(F.md5("key"))) - 1).alias("r"))
    found = df.select(key, F.explode(F.array_distinct(fragments)).alias("fragment")).join(F.broadcast(n))  # one row
    found = found.withColumn("r", F.conv(F.substring(F.md5("fragment"), 1, 8), 16, 10).cast("long") % F.col("n")).join(ranked, "r").filter("fragment <> substitute")
    swaps = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.length("fragment")).alias("order"), "fragment", "substitute"))).alias("swaps"))
    swapped = F.aggregate("swaps", F.col(text), lambda t, s: F.replace(t, s["fragment"], s["substitute"]))
    return df.join(swaps, key, "left").withColumn(column, F.coalesce(swapped, F.col(text))).drop("swaps")


def stack_conditions(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """One row per key and condition whose text is not null."""
    cells = F.array(*[F.struct(F.lit(k).alias("cond"), c.alias("prefix")) for k, c in conditions.items()])
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.cond", "c.prefix").filter("prefix IS NOT NULL")

