"""The whole audit of tagged responses, from text to scores, as one DataFrame transformation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceaudit.functions import scores as sc
from traceaudit.functions import similarity as sim
from traceaudit.functions import text as tx
from traceaudit.operators import claims as cl


#: Task families: text to text, yes or no, a set of structures, text to structure, a changed structure, a structure with wanted counts.
FAMILIES = ("caption", "label", "set", "structure", "edit", "constraint")


def extract(df: DataFrame, answer: str = "answer", family: str | None = None) -> DataFrame:
    """Answered rows with pred (the answer) and trace (the reasoning, or the whole text). With a column of families, pred is the yes or
    no of label tasks, and untagged answers are taken whole by caption and set tasks and searched by structure tasks."""
    rows = df.filter(F.col(answer).isNotNull() & (F.col(answer) != ""))
    pred = tx.extract_answer(F.col(answer))
    if family:
        whole, f = F.coalesce(pred, tx.strip(F.col(answer))), F.col(family)
        label = F.nullif(F.regexp_extract(F.lower(whole), r"(?U)\b(yes|no)\b", 1), F.lit(""))
        pred = F.when(f == "label", label).when(f.isin("caption", "set"), whole).when(f == "structure", tx.last_resort_structure(F.col(answer))).otherwise(pred)
    return rows.withColumns({"pred": pred, "trace": tx.reasoning_or_answer(F.col(answer))})


def verify(df: DataFrame, lexicon: dict[str, tuple[str, ...]], evidence: Column, family: str | None = None) -> DataFrame:
    """claimed, evidence, verified and fabricated groups of each trace. evidence: an array of group names. With a column of families,
    caption tasks also claim what the answer names, and structure tasks nothing that is named as the origin of something."""
    if family:
        text = F.when(F.col(family) == "caption", F.concat_ws(" ", "trace", "pred")).when(F.col(family) != "structure", F.col("trace"))
        rows = df.withColumn("_text", F.when(F.col(family) == "structure", F.col("trace")))
        rows = cl.named_groups_outside(rows, "_text", lexicon, column="_outside").withColumn("evidence", evidence)
        rows = rows.withColumn("claimed", F.when(F.col(family) == "structure", F.col("_outside")).otherwise(cl.named_groups(text, lexicon))).drop("_text", "_outside")
    else:
        rows = df.withColumns({"claimed": cl.named_groups(F.col("trace"), lexicon), "evidence": evidence})
    verified, fabricated = cl.verify(F.col("claimed"), F.col("evidence"))
    return rows.withColumns({"verified": verified, "fabricated": fabricated})


def task_performance(kind: Column, exact: Column, caption: Column, success: Column) -> Column:
    """0..1: the caption score of caption tasks, the success of constraint tasks, exact match otherwise; a null measure counts as 0."""
    return F.coalesce(F.when(kind == "caption", caption).when(kind == "constraint", success.cast("double")).otherwise(exact.cast("double")), F.lit(0.0))


def caption_performance(answer: Column, truth: Column, longest: int = 500) -> Column:
    """BLEU-4 of the answer, or of the first answer pair where there is none, cut to `longest` characters; 0 where either side is empty."""
    said = F.substring(F.coalesce(tx.extract_answer(answer), tx.first_answer(answer), F.lit("")), 1, longest)
    return F.when((said != "") & (F.coalesce(truth, F.lit("")) != ""), sim.bleu(truth, said, 4)).otherwise(F.lit(0.0))


def score(df: DataFrame, generic: tuple[str, ...], similarity: Column) -> DataFrame:
    """The four dimensions, overall, perf, specific claim counts and trace length. similarity: of pred to the truth, null without pred."""
    s = F.coalesce(similarity, F.lit(0.0))
    rows = df.withColumns({
        "ir": sc.self_contradiction(F.col("trace")).cast("double"),
        "io": sc.caption_validity(F.col("pred")),
        "er": sc.fabrication(F.size("claimed"), F.size("fabricated")),
        "eo": sc.caption_deviation(s),
        "perf": s,
        "n_verified": F.size(cl.specific(F.col("verified"), generic)),
        "n_fabricated": F.size(cl.specific(F.col("fabricated"), generic)),
        "trace_length": F.length("trace"),
    })
    skip = {"er": F.size("claimed") == 0, "eo": F.col("pred").isNull()}
    return rows.withColumn("overall", sc.overall({k: F.col(k) for k in ("ir", "io", "er", "eo")}, skip))


def score_by_family(df: DataFrame, generic: tuple[str, ...], family: str, measures: dict[str, Column]) -> DataFrame:
    """As score, with the rules of each row's family for io, er, eo, perf and what is skipped; also pred_valid, validity_issue and exact.

    measures, those of absent families left out:
      caption: similarity. label: truth_label. edit: source_similarity, unchanged, has_source.
      set: parts and valid_parts (counts), pred_set and truth_set (canonical parts), set_similarity.
      structure: exact, structure_similarity (null where unknown), violations, wanted and pred_groups (arrays), fragments, fragments_found, classes, wrong_classes.
      constraint: targets and got (maps). structure, edit, constraint: valid. edit, constraint: success.
    An unknown or null family fails; operators.prepare.route_tasks sets such rows apart before.
    """
    nothing = {"wanted": "array<string>", "pred_groups": "array<string>", "pred_set": "array<string>", "truth_set": "array<string>", "targets": "map<string,string>", "got": "map<string,int>", "truth_label": "string"}
    m = lambda k: measures.get(k, F.lit(None).cast(nothing.get(k, "double")))
    count = lambda k: F.coalesce(m(k), F.lit(0))
    flag = lambda k: F.coalesce(measures.get(k, F.lit(False)), F.lit(False))
    array = lambda k: F.coalesce(m(k), F.array().cast("array<string>"))
    f, pred = F.col(family), F.col("pred")

    def pick(**by: Column) -> Column:
        """The column of the row's family."""
        out = F.raise_error(F.concat(F.lit("Unknown task family: "), F.coalesce(f, F.lit("null"))))
        for name in FAMILIES:
            out = F.when(f == name, by[name]).otherwise(out)
        return out

    similarity, structure, claims, fabricated = F.coalesce(m("similarity"), F.lit(0.0)), pred.isNotNull() & flag("valid"), F.size("claimed"), F.size("fabricated")
    words = F.size(F.filter(F.split(F.coalesce(pred, F.lit("")), r"\s+"), lambda w: w != ""))
    same_label = F.coalesce(pred == F.lower(m("truth_label")), F.lit(False))
    same_set = (F.size(array("pred_set")) > 0) & (F.sort_array(array("pred_set")) == F.sort_array(array("truth_set")))
    broken, ratio, never = F.when(structure, 0.0).otherwise(80.0), sc.fabrication(claims, fabricated), F.lit(False)
    traced = F.length(tx.strip(F.col("trace"))) > 20
    shape = sc.structure_validity(
        count("violations"), array("wanted"), F.when(traced, F.col("claimed")).otherwise(F.array().cast("array<string>")), array("pred_groups"), F.when(traced, count("fragments")).otherwise(0), F.when(traced, count("fragments_found")).otherwise(0)
    )
    edited = sc.edit_deviation(structure, flag("has_source"), F.coalesce(m("source_similarity"), F.lit(0.0)), flag("unchanged"))
    wanted = F.when(structure, sc.constraint_deviation(m("targets"), m("got"))).otherwise(100.0)
    classed = sc.fabrication(claims, fabricated, count("wrong_classes"), count("classes"))
    eo = pick(
        caption=sc.caption_deviation(similarity), label=sc.label_deviation(pred, same_label), set=sc.set_deviation(array("pred_set"), array("truth_set"), m("set_similarity")),
        structure=F.when(structure, sc.deviation(flag("exact"), m("structure_similarity"))).otherwise(0.0), edit=edited, constraint=wanted,
    )
    rows = df.withColumns({
        "ir": sc.self_contradiction(F.col("trace")).cast("double"),
        "io": pick(caption=sc.caption_validity(pred), label=sc.label_validity(pred), set=sc.set_validity(count("parts"), count("valid_parts")), structure=F.when(structure, shape).otherwise(0.0), edit=broken, constraint=broken),
        "er": pick(caption=ratio, label=ratio, set=ratio, structure=classed, edit=ratio, constraint=ratio),
        "eo": eo,
        "pred_valid": pick(caption=words >= 3, label=pred.isNotNull(), set=(count("parts") > 0) & (count("parts") == count("valid_parts")), structure=structure, edit=structure, constraint=structure),
        "exact": pick(caption=similarity >= 0.85, label=same_label, set=same_set, structure=structure & flag("exact"), edit=eo == 0, constraint=eo == 0),
        "no_io": pick(caption=never, label=never, set=never, structure=~structure, edit=never, constraint=never),
        "no_er": pick(caption=claims == 0, label=claims == 0, set=claims == 0, structure=never, edit=claims == 0, constraint=claims == 0),
        "no_eo": pick(caption=never, label=pred.isNull(), set=F.size(array("pred_set")) == 0, structure=~structure, edit=never, constraint=never),
        "n_verified": F.size(cl.specific(F.col("verified"), generic)),
        "n_fabricated": F.size(cl.specific(F.col("fabricated"), generic)),
        "trace_length": F.length("trace"),
    })
    kind = F.when(f.isin("edit", "constraint"), "constraint").otherwise(f)
    issue = F.when(~F.col("pred_valid"), F.when(F.coalesce(pred, F.lit("")) == "", "no_prediction").otherwise("invalid"))
    skip = {k: F.col(f"no_{k}") for k in ("io", "er", "eo")}
    rows = rows.withColumns({"perf": task_performance(kind, F.col("exact"), similarity, count("success")), "validity_issue": issue})
    return rows.withColumn("overall", sc.overall({k: F.col(k) for k in ("ir", "io", "er", "eo")}, skip))


def diagnose(df: DataFrame, lexicon: dict[str, tuple[str, ...]], generic: tuple[str, ...], evidence: Column, truth: str = "gt") -> DataFrame:
    """All of it for rows with answer and truth: null and empty answers drop out, other columns stay."""
    rows = verify(extract(df), lexicon, evidence)
    similarity = F.when(F.col("pred").isNotNull(), sim.token_jaccard(F.col("pred"), F.col(truth)))
    return score(rows, generic, similarity)


def register(spark: SparkSession) -> None:
    """As SQL functions on Arrow batches: bleu2(reference, hypothesis), bleu4, and groups_outside(text, lexicon), the groups of a
    map<string,array<string>> that the text names outside derivations (see claims.named_groups_outside)."""
    spark.udf.register("bleu2", F.pandas_udf(_bleu2, "double"))
    spark.udf.register("bleu4", F.pandas_udf(_bleu4, "double"))
    spark.udf.register("groups_outside", F.pandas_udf(_groups_outside, "array<string>"))


def _bleu2(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([sim.bleu_score(x, y, 2) for x, y in zip(reference, hypothesis, strict=True)])


def _bleu4(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([sim.bleu_score(x, y, 4) for x, y in zip(reference, hypothesis, strict=True)])


def _groups_outside(texts: pd.Series, lexicons: pd.Series) -> pd.Series:
    return pd.Series([cl.groups_outside(t or "", {g: list(w) for g, w in dict(lexicon).items()}) for t, lexicon in zip(texts, lexicons, strict=True)])
