"""Error and performance scores, 0 to 100, as arithmetic on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceaudit.functions.text import ascii_borders, normalize_text, once, strip

# Correction phrases with their weights, flip phrases, weights of the four dimensions, bands.
CORRECTIONS = (
    (r"\bwait\b.*\b(?:wrong|incorrect|mistake|no)\b", 5),
    (r"\bactually\b.*\b(?:should be|is not|isn't)\b", 4),
    (r"\blet me reconsider\b", 4),
    (r"\bi was wrong\b|\bi made a mistake\b|\bthat's incorrect\b", 6),
    (r"\bcorrection\b", 3),
    (r"\bon second thought\b", 3),
    (r"\bno,?\s*(?:wait|actually)\b", 4),
)
FLIP = r"\b(?:this (?:is|should be)|the (?:smiles|molecule|structure) (?:is|should be))\s+([^\n.]{5,50})"
#: For each correction, words of which a match holds at least one; a text without them is not searched.
CORRECTION_WORDS = (("wait",), ("actually",), ("reconsider",), ("wrong", "mistake", "incorrect"), ("correction",), ("second thought",), ("wait", "actually"))
#: Each match of FLIP holds one of these.
FLIP_WORDS = ("this is", "this should be", "the smiles ", "the molecule ", "the structure ")
WEIGHTS = {"ir": 0.15, "io": 0.25, "er": 0.25, "eo": 0.35}


def self_contradiction(trace: Column) -> Column:
    """Weighted correction phrases, excess flips, repeated sentences and excess length; 0 for null and under 20 characters."""
    has = lambda t, words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    flips = lambda n: F.when(n > 3, (n - 3) * 5).otherwise(0)

    def phrases(t: Column) -> Column:
        corrections = [F.when(has(t, words), F.regexp_count(t, F.lit(ascii_borders(p))) * w).otherwise(0) for (p, w), words in zip(CORRECTIONS, CORRECTION_WORDS, strict=True)]
        return reduce(lambda a, b: a + b, corrections) + F.when(has(t, FLIP_WORDS), once(F.regexp_count(t, F.lit(ascii_borders(FLIP))), flips)).otherwise(0)

    def repeats(t: Column) -> Column:
        sentences = F.filter(F.split(t, r" ?\. ?"), lambda s: F.length(s) > 20)
        return once(once(sentences, lambda s: F.size(s) - F.size(F.array_distinct(s))), lambda r: F.when(r > 2, r * 3).otherwise(0))

    n = F.length(trace)
    total = once(normalize_text(trace), lambda t: phrases(t) + repeats(t)) + F.when(n > 10000, F.least(F.lit(20.0), (n - 10000) / F.lit(1000.0))).otherwise(0.0)
    return F.when(F.length(strip(trace)) >= 20, F.least(F.lit(100.0), total)).otherwise(F.lit(0.0))


def fabrication(claimed: Column, fabricated: Column, wrong_classes: Column | None = None, classes: Column | None = None) -> Column:
    """min(100, 60 fabricated / claimed), or with wrong_classes min(100, 15 (5 fabricated + 8 wrong) / checks); 0 without claims. classes: how many were named (all of them wrong where it is not given)."""
    if wrong_classes is None:
        return F.when(claimed > 0, F.least(F.lit(100.0), F.lit(60.0) * fabricated / claimed)).otherwise(F.lit(0.0))
    checks = F.greatest(claimed, F.lit(1)) + F.when(wrong_classes > 0, wrong_classes if classes is None else classes).otherwise(0)
    return F.least(F.lit(100.0), F.lit(15.0) * (5 * fabricated + 8 * wrong_classes) / checks)


def caption_validity(caption: Column, phrase: str = "molecule is") -> Column:
    """80 under 10 characters; else 25 without the phrase plus 20 under 8 words."""
    c = strip(F.coalesce(caption, F.lit("")))
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.when(F.length(c) < 10, 80.0).otherwise(F.when(F.lower(c).contains(phrase), 0.0).otherwise(25.0) + F.when(words < 8, 20.0).otherwise(0.0))


def label_validity(label: Column) -> Column:
    return F.when(label.isNull(), 70.0).otherwise(0.0)


def set_validity(parts: Column, valid: Column) -> Column:
    """80 times the share of invalid parts; 80 without parts."""
    return F.when(parts > 0, F.lit(80.0) * (parts - valid) / parts).otherwise(F.lit(80.0))


def structure_validity(violations: Column, wanted: Column, named: Column, found: Column, fragments: Column, fragments_found: Column) -> Column:
    """Of a valid structure against its description and trace: 10 for each class violation (40 at most), 30 times the share of wanted groups that it
    lacks, 25 times that of the wanted groups named in the trace, 15 times the share of the trace's fragments that it lacks. wanted, named, found: arrays of groups."""
    known = F.array_intersect(wanted, named)
    lacking = lambda groups: F.coalesce(F.try_divide(F.size(F.array_except(groups, found)).cast("double"), F.size(groups)), F.lit(0.0))
    apart = F.coalesce(F.try_divide((fragments - fragments_found).cast("double"), fragments), F.lit(0.0))
    return F.least(F.lit(100.0), F.least(F.lit(40.0), violations * F.lit(10.0)) + 30 * lacking(wanted) + 25 * lacking(known) + 15 * apart)


def label_deviation(label: Column, exact: Column) -> Column:
    """0 without a label, as its absence counts as invalid."""
    return F.when(label.isNull() | exact, 0.0).otherwise(100.0)


def set_deviation(predicted: Column, truth: Column, similarity: Column) -> Column:
    """Of two arrays of canonical parts: 80 if one side is empty, 0 if they are equal as multisets, else 100 (1 - similarity)."""
    a, b = F.sort_array(predicted), F.sort_array(truth)
    return F.when(a == b, 0.0).when((F.size(a) == 0) | (F.size(b) == 0), 80.0).otherwise(F.greatest(F.lit(0.0), 100 * (1 - F.coalesce(similarity, F.lit(0.0)))))


def deviation(exact: Column, similarity: Column) -> Column:
    return F.when(exact, 0.0).when(similarity.isNull(), 80.0).otherwise(100 * (1 - similarity))


def caption_deviation(jaccard: Column) -> Column:
    return F.when(jaccard >= 0.85, 0.0).otherwise(100 * (1 - jaccard))


def edit_deviation(valid: Column, has_source: Column, similarity: Column, unchanged: Column | None = None) -> Column:
    """Of an edited item against its source: 60 unchanged (similarity 1 where it is not given), 80 too far, 40 hardly changed, else 50 (1 - similarity)."""
    return F.when(~valid, 100.0).when(~has_source, 50.0).when(similarity >= 1.0 if unchanged is None else unchanged, 60.0).when(similarity < 0.2, 80.0).when(similarity > 0.95, 40.0).otherwise(50 * (1 - similarity))


def constraint_deviation(targets: Column, got: Column) -> Column:
    """Mean of |got - target| / target over positive whole targets (text), in percent, 100 at most; 0 without one."""
    wanted = F.map_filter(F.transform_values(targets, lambda k, v: v.try_cast("int")), lambda k, v: v > 0)
    parts = F.transform(F.map_entries(wanted), lambda e: F.abs(F.coalesce(got[e["key"]], F.lit(0)) - e["value"]) / e["value"].cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(parts) > 0, F.least(F.lit(100.0), 100 * total / F.size(parts))).otherwise(F.lit(0.0))


def constraint_success(targets: Column, got: Column) -> Column:
    """1 if all positive targets are met exactly, else 0. A null or blank target counts as 0 and demands nothing; one that is no whole number fails."""
    values = F.transform_values(targets, lambda k, v: F.when(strip(F.coalesce(v, F.lit(""))) == "", F.lit(0)).otherwise(v.try_cast("int")))
    ok = F.forall(F.map_entries(values), lambda e: e["value"].isNotNull() & ((e["value"] <= 0) | (got[e["key"]].eqNullSafe(e["value"]))))
    return F.coalesce(ok, F.lit(False)).cast("int")


def edit_success(kind: Column, source: Column, got: Column, added_source: Column | None = None, added: Column | None = None) -> Column:
    """add: one more than the source; delete: one fewer; substitute: one fewer of the one and one more of the other group (added); else (optimise up or down): moved strictly that way."""
    ok = F.when(kind == "add", got == source + 1).when(kind == "delete", got == source - 1).when(kind == "down", got < source).when(kind == "up", got > source)
    if added is not None:
        ok = ok.when(kind == "substitute", (got == source - 1) & (added == added_source + 1))
    return F.coalesce(ok, F.lit(False)).cast("int")


def overall(scores: dict[str, Column], skipped: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the dimensions that are not skipped, weights renormalised; null if all are."""
    weights = weights or WEIGHTS
    on = {k: ~F.coalesce(skipped.get(k, F.lit(False)), F.lit(False)) for k in scores}
    total = reduce(lambda a, b: a + b, [F.when(on[k], weights[k] * F.coalesce(scores[k], F.lit(0.0))).otherwise(0.0) for k in scores])
    mass = reduce(lambda a, b: a + b, [F.when(on[k], weights[k]).otherwise(0.0) for k in scores])
    return F.when(mass > 0, total / mass)


def band(value: Column, cuts: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The name of the first cut that the value lies under, the last name otherwise; null stays null."""
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names, strict=False))):
        out = F.when(value < cut, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def er_bin(er: Column) -> Column:
    return F.when(er.isNull(), "na").when(er == 0, "0").when(er <= 25, "<=25").otherwise(">25")


def grounded(verified: Column, fabricated: Column, cap: int = 5) -> Column:
    """2 min(verified, cap) / cap times the precision of the claims; 0 without verified ones."""
    return F.when(verified > 0, 2 * F.least(verified, F.lit(cap)) / float(cap) * verified / (verified + fabricated)).otherwise(F.lit(0.0))


def direction(instruction: Column) -> Column:
    """down where an instruction speaks of lower, decreas or reduc, else up."""
    return F.when(F.lower(instruction).rlike("lower|decreas|reduc"), "down").otherwise("up")


def truth_of(json: Column, field: str) -> Column:
    """A field of a truth in JSON; empty where that is no JSON object or lacks it."""
    return F.coalesce(F.get_json_object(json, f"$.{field}"), F.lit(""))


def grounded_reward(fmt: Column, accuracy: Column, overall_score: Column, ground: Column, er: Column, coupled: bool, bonus: float = 0.0, length: Column | None = None, failed: Column | None = None) -> Column:
    """.1 format + .4 accuracy + .4 (1 - overall / 100) + .2 grounded (+ bonus * length); coupled: accuracy counts only without fabrication. A row that failed to be
    checked has an overall score of 100 and neither accuracy nor grounding."""
    if failed is not None:
        bad = F.coalesce(failed, F.lit(False))
        accuracy, ground, overall_score = F.when(bad, 0.0).otherwise(accuracy), F.when(bad, 0.0).otherwise(ground), F.when(bad, 100.0).otherwise(overall_score)
    acc = F.when(er == 0, accuracy).otherwise(F.lit(0.0)) if coupled else accuracy
    out = 0.1 * fmt + 0.4 * acc + 0.4 * (1 - overall_score / 100) + 0.2 * ground
    return out + bonus * length if length is not None and bonus else out
