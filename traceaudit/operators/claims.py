"""Claims: which groups of a lexicon a text names, checked against evidence. Lexicons are parameters: {group: (keyword, ...)}."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.text import normalize_text, once

#: Phrases near a keyword that make it no claim about the subject itself, and how far they reach.
DERIVATION = (
    r"derived from|deriv(?:es|ed|ing)|obtained (?:from|by)|condens|replac|convert|precursor|starting material|reactant|formed (?:by|from)|comes from|originat"
    r"|tautomer|conjugate (?:acid|base)|reacts? with|from (?:the )?(?:acid|amine|alcohol|aldehyde|acyl|carboxylic|parent)|of (?:the )?(?:acid|parent)"
)
DERIVATION_WINDOW = 60


def keyword_pattern(keywords) -> str:
    """One pattern for any of the keywords as whole words of a normalised text, plural s or es allowed."""
    return r"(?<![a-z])(?:" + "|".join(re.escape(k.lower()) for k in keywords) + r")(?:e?s)?(?![a-z])"


def named_groups(text: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """Sorted names of the groups with a keyword in the text; empty for null. The text is normalised once; a pattern runs only where one of its keywords stands somewhere in the text."""

    def groups(t: Column) -> Column:
        near = lambda words: reduce(lambda a, b: a | b, [t.contains(k.lower()) for k in words])
        return F.sort_array(F.array_compact(F.array(*[F.when(near(words) & t.rlike(keyword_pattern(words)), F.lit(g)) for g, words in lexicon.items()])))

    return once(normalize_text(F.coalesce(text, F.lit(""))), groups)


def groups_outside(text: str, lexicon, phrases: str = DERIVATION, window: int = DERIVATION_WINDOW) -> list[str]:
    """The groups of one normalised text that stand somewhere without the phrases around them. (re keeps compiled patterns.)"""
    near = re.compile(phrases)
    stands = lambda words: any(not near.search(text[max(0, m.start() - window) : m.end() + window]) for m in re.finditer(keyword_pattern(words), text))
    return sorted(g for g, words in lexicon.items() if stands(words))


def stands_outside(text: Column, pattern: str, phrases: str, window: int) -> Column:
    """Whether some match of the pattern has none of the phrases among its own characters and `window` ones on both sides. The text is cut at its matches, and
    one walk along the pieces keeps the place that it has reached and whether such a match was found; only surroundings of matches are searched for phrases."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("match"))
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("found"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["before"])
        end = begin + F.length(x["match"])
        low = F.greatest(begin - window, F.lit(0))
        alone = ~F.substring(text, low + 1, end + window - low).rlike(phrases)
        after_last = x["match"].isNull()  # the piece behind the last match
        return F.struct(F.coalesce(end, begin).alias("at"), (s["found"] | (~after_last & F.coalesce(alone, F.lit(False)))).alias("found"))

    return F.aggregate(pieces, start, step, lambda s: s["found"])


def named_groups_outside(df: DataFrame, text: str, lexicon: dict[str, tuple[str, ...]], phrases: str = DERIVATION, window: int = DERIVATION_WINDOW, column: str = "claimed") -> DataFrame:
    """As named_groups, but a group counts only with an occurrence whose surroundings (`window` characters on both sides) hold none of the phrases."""

    def groups(t: Column) -> Column:
        near = lambda words: reduce(lambda a, b: a | b, [t.contains(k.lower()) for k in words])
        cases = [F.when(near(words) & stands_outside(t, keyword_pattern(words), phrases, window), F.lit(g)) for g, words in lexicon.items()]
        return F.sort_array(F.array_compact(F.array(*cases)))

    return df.withColumn(column, once(normalize_text(F.coalesce(F.col(text), F.lit(""))), groups))


def verify(claimed: Column, evidence: Column) -> tuple[Column, Column]:
    """(verified, fabricated): claims inside and outside of the evidence."""
    return F.sort_array(F.array_intersect(claimed, evidence)), F.sort_array(F.array_except(claimed, evidence))


def evidence_for_task(task: Column, sources: dict[str, Column], by_task: dict[str, tuple[str, ...]], default: tuple[str, ...]) -> Column:
    """Union of the evidence arrays that a task admits."""
    union = lambda names: F.sort_array(F.array_distinct(F.flatten(F.array(*[F.coalesce(sources[n], F.array().cast("array<string>")) for n in names]))))
    return reduce(lambda rest, item: F.when(task == item[0], union(item[1])).otherwise(rest), by_task.items(), union(default))


def group_diff(predicted: Column, truth: Column) -> tuple[Column, Column]:
    """(missing, extra) groups of the prediction."""
    return F.sort_array(F.array_except(truth, predicted)), F.sort_array(F.array_except(predicted, truth))


def specific(groups: Column, generic) -> Column:
    return F.array_except(groups, F.array(*[F.lit(g) for g in generic]))


def claims_long(df: DataFrame, keys: list[str], generic) -> DataFrame:
    """One row per claim: keys, group, generic, verdict; df has verified and fabricated."""
    both = F.concat(F.transform("verified", lambda g: F.struct(g.alias("group"), F.lit("verified").alias("verdict"))), F.transform("fabricated", lambda g: F.struct(g.alias("group"), F.lit("fabricated").alias("verdict"))))
    return df.select(*keys, F.explode(both).alias("c")).select(*keys, "c.group", F.col("c.group").isin(*generic).alias("generic"), "c.verdict")


def first_claim_position(trace: Column, fabricated: Column) -> Column:
    """Earliest place of a fabricated group's name (as it is, _ as blank, or without _) over the length of the trace; null if none occurs."""
    spellings = F.flatten(F.transform(fabricated, lambda g: F.array(F.lower(g), F.replace(F.lower(g), F.lit("_"), F.lit(" ")), F.replace(F.lower(g), F.lit("_"), F.lit("")))))
    first = once(F.lower(trace), lambda low: F.array_min(F.filter(F.transform(spellings, lambda s: F.instr(low, s)), lambda p: p > 0)))
    return F.try_divide((first - 1).cast("double"), F.length(trace))


def class_rule_violations(df: DataFrame, rules: DataFrame, described: str | None = None) -> DataFrame:
    """Claimed classes (class) of df that break a rule of rules(class, min_rings, min_carbons, requires_n, requires_o, requires_p): one row each with
    what is broken, an entry for each broken rule.

    df: (class, rings, carbons, has_n, ...); of the rules' columns those that are absent demand nothing, like null ones. described: a column of
    classes that the description names, which are not checked.
    """
    low = lambda have, need: F.coalesce(F.col(have) < F.col(need), F.lit(False))
    elements = [x for x in ("n", "o", "p") if f"requires_{x}" in rules.columns]
    lacks = [F.when(F.col(f"requires_{x}") & ~F.coalesce(F.col(f"has_{x}"), F.lit(False)), x) for x in elements]
    rows = df if described is None else df.filter(~F.coalesce(F.array_contains(described, F.col("class")), F.lit(False)))
    return (
        rows.join(F.broadcast(rules), "class")  # rules are a parameter list of a few rows
        .withColumn("broken", F.array_compact(F.array(F.when(low("rings", "min_rings"), "rings"), F.when(low("carbons", "min_carbons"), "carbons"), *lacks)))
        .filter(F.size("broken") > 0)
    )


def description_faults(described: Column, traced: Column, predicted: Column) -> tuple[Column, Column]:
    """(missing, unfaithful) groups: described but not predicted, and described and traced but not predicted."""
    return F.sort_array(F.array_except(described, predicted)), F.sort_array(F.array_except(F.array_intersect(described, traced), predicted))


def mismatches(formula: Column, true_formula: Column, rings: Column, true_rings: Column) -> Column:
    """Names of what differs, of formula and rings; nulls on one side differ, on both sides they do not."""
    return F.array_compact(F.array(F.when(~formula.eqNullSafe(true_formula), "formula"), F.when(~rings.eqNullSafe(true_rings), "rings")))


def named_by_pattern(text: Column, patterns: dict[str, str]) -> Column:
    """Sorted names whose own pattern is in the normalised text, for words that no keyword list covers."""
    return once(normalize_text(F.coalesce(text, F.lit(""))), lambda t: F.sort_array(F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in patterns.items()]))))


def matched_mention(left: Column, right: Column, keywords: list[str]) -> Column:
    """struct(keyword, left_at, right_at) of the first keyword, longest first, that occurs in both texts; null if none does."""
    order = sorted(keywords, key=lambda k: (-len(k), k))
    a, b = F.lower(left), F.lower(right)
    hit = lambda k: F.when((F.instr(a, F.lit(k)) > 0) & (F.instr(b, F.lit(k)) > 0), F.struct(F.lit(k).alias("keyword"), F.instr(a, F.lit(k)).alias("left_at"), F.instr(b, F.lit(k)).alias("right_at")))
    return F.coalesce(*[hit(k) for k in order])


def copied_from_trace(trace: Column, answer: Column) -> Column:
    """Whether the answer stands in the trace, both normalised; null where either is."""
    return once(normalize_text(trace), lambda t: t.contains(normalize_text(answer)))


def copied_fragments(df: DataFrame, facts: DataFrame, key: str, fragments: Column, answer: str) -> DataFrame:
    """(key, copied): whether the canonical form of the answer is that of one of the trace's fragments, by facts(key, canonical). An answer or fragment without facts copies nothing."""
    canonical = facts.select(F.col("key").alias("_f"), "canonical")
    mine = df.select(key, F.col(answer).alias("_f")).join(canonical, "_f").select(key, "canonical")
    found = df.select(key, F.explode(F.array_distinct(fragments)).alias("_f")).join(canonical, "_f").select(key, "canonical").distinct()
    hit = mine.join(found, [key, "canonical"], "left_semi").select(key, F.lit(True).alias("copied"))
    return df.select(key).join(hit, key, "left").select(key, F.coalesce("copied", F.lit(False)).alias("copied"))
