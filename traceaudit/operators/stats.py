"""Roll-ups of verdicts, outcomes, tokens and annotations. Group keys are few; partial aggregation makes their shuffles small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.operators.quantiles import elements_at, join_on, quantiles


def share(cond: Column) -> Column:
    """Percentage of rows where cond is true, over rows where it is not null."""
    return 100 * F.avg(cond.cast("double"))


def task_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Per model and task over rows (perf 0..1, er, overall, ir, io, eo, n_verified, n_fabricated, trace_length):
    n, performance in percent, over clean (er = 0) and fabricating rows (null if there are none), share of clean rows, mean scores,
    grounded claims per row, pooled claim precision (null without claims), mean length, verified claims per 1000 characters."""
    er = F.col("er")
    v, f = F.sum("n_verified"), F.sum("n_fabricated")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        (100 * F.avg("perf")).alias("perf"),
        (100 * F.avg(F.when(er == 0, F.col("perf")))).alias("perf_er0"),
        (100 * F.avg(F.when(er > 0, F.col("perf")))).alias("perf_erpos"),
        share(er == 0).alias("pct_er0"),
        F.avg("overall").alias("overall"),
        *[F.avg(c).alias(c) for c in ("ir", "io", "er", "eo")],
        F.avg("n_verified").alias("grounded_claims"),
        F.try_divide(100.0 * v, v + f).alias("claim_precision"),
        F.avg("trace_length").alias("length"),
        (1000.0 * v / F.greatest(F.sum("trace_length"), F.lit(1))).alias("info"),
    )


#: Columns that task_stats reads.
TASK_ROW = "perf double, er double, overall double, ir double, io double, eo double, n_verified int, n_fabricated int, trace_length int"
_MEANS = ("perf", "perf_er0", "perf_erpos", "clean", "overall", "ir", "io", "er", "eo", "n_verified", "trace_length")


def task_sums(df: DataFrame, by: list[str]) -> DataFrame:
    """Per `by`, what task_stats is made of, as sums and counts that can be added up over parts of the rows."""
    er = F.col("er")
    values = {"perf_er0": F.when(er == 0, F.col("perf")), "perf_erpos": F.when(er > 0, F.col("perf")), "clean": (er == 0).cast("double")}
    sums = [f(values.get(c, F.col(c)).cast("double")).alias(f"{c}_{x}") for c in _MEANS for f, x in ((F.sum, "sum"), (F.count, "count"))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *sums, F.sum(F.col("n_fabricated").cast("double")).alias("n_fabricated_sum"))


def merge_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """Rows of task_sums, added up per `by`."""
    return sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums.columns if c not in by])


def stats_of_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """task_stats from task_sums."""
    mean = lambda c: F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_count"))
    v, f = F.col("n_verified_sum"), F.col("n_fabricated_sum")
    percent = {"perf": "perf", "perf_er0": "perf_er0", "perf_erpos": "perf_erpos", "pct_er0": "clean"}
    return sums.select(
        *by,
        "n",
        *[(100 * mean(c)).alias(k) for k, c in percent.items()],
        *[mean(c).alias(c) for c in ("overall", "ir", "io", "er", "eo")],
        mean("n_verified").alias("grounded_claims"),
        F.try_divide(100.0 * v, v + f).alias("claim_precision"),
        mean("trace_length").alias("length"),
        (1000.0 * v / F.greatest(F.col("trace_length_sum"), F.lit(1.0))).alias("info"),
    )


def task_extras(df: DataFrame, by: list[str], valid: Column, similarity: Column, entropies: DataFrame, entropy: str) -> DataFrame:
    """Per `by`: validity in percent, mean similarity over rows that have one, and the mean of entropies(by, entropy), null where a group has none."""
    own = df.groupBy(*by).agg(share(valid).alias("validity"), F.avg(similarity).alias("mean_similarity"))
    return own.join(entropies.groupBy(*by).agg(F.avg(entropy).alias("mean_entropy")), by, "left")


def stratified(df: DataFrame, by: list[str], er: str, aggs: list[Column], null_er: str = "drop") -> DataFrame:
    """aggs per `by` and stratum all / er0 / erpos in one pass over grouping sets. null_er: drop (in `all` only), clean or erpos."""
    e = F.col(er)
    unknown = {"drop": F.lit(None).cast("string"), "clean": F.lit("er0"), "erpos": F.lit("erpos")}[null_er]
    marked = df.withColumn("_s", F.when(e.isNull(), unknown).when(e == 0, "er0").otherwise("erpos"))
    keys = [F.col(c) for c in by]
    out = marked.groupingSets([[*keys, F.col("_s")], keys], *keys, F.col("_s")).agg(F.grouping("_s").alias("_g"), *aggs)
    return out.filter("_g = 1 OR _s IS NOT NULL").withColumn("stratum", F.when(F.col("_g") == 1, "all").otherwise(F.col("_s"))).drop("_s", "_g")


def family_stats(df: DataFrame, by: list[str], metrics: list[str], n: str = "n") -> DataFrame:
    """n-weighted means of task-level metrics; a null metric's task has no weight in that metric."""
    mean = lambda m: F.try_divide(F.sum(F.col(m) * F.col(n)), F.sum(F.when(F.col(m).isNotNull(), F.col(n)))).alias(m)
    return df.groupBy(*by).agg(F.sum(n).alias("n"), *[mean(m) for m in metrics])


def mean_of_tasks(df: DataFrame, model: str, task: str, value: str) -> DataFrame:
    """Per model: mean over its tasks' means, and the pooled mean over its rows."""
    per = df.groupBy(model, task).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("c"))
    return per.groupBy(model).agg(F.count("*").alias("n_tasks"), F.avg("m").alias("mean_of_tasks"), F.try_divide(F.sum("s"), F.sum("c")).alias("pooled"))


def decoupling_gap(df: DataFrame) -> DataFrame:
    return df.withColumn("gap", F.col("perf_er0") - F.col("perf_erpos"))


def compare_variants(df: DataFrame, by: list[str], variant: str, base: str, other: str, metric: str) -> DataFrame:
    wide = df.groupBy(*by).pivot(variant, [base, other]).agg(F.max(metric))
    return wide.select(*by, F.col(base).alias("base"), F.col(other).alias("variant"), (F.col(other) - F.col(base)).alias("change"))


def mechanism_ladder(df: DataFrame, model: str, task: str) -> DataFrame:
    """Per model: n, claims per response, fabrication rate per claim as the plain mean over tasks that have claims, shares of hedging and abstaining
    over all responses, mean first position of a fabricated claim over those found, and how many were."""
    v, f = F.sum("n_verified"), F.sum("n_fabricated")
    per = df.groupBy(model, task).agg(
        F.count("*").alias("c"), v.alias("v"), f.alias("f"), F.try_divide(f.cast("double"), v + f).alias("rate"), F.sum(F.col("hedge").cast("int")).alias("h"), F.sum(F.col("abstain").cast("int")).alias("a"), F.sum("position").alias("p"), F.count("position").alias("np")
    )
    return per.groupBy(model).agg(
        F.sum("c").alias("n"),
        (F.sum(F.col("v") + F.col("f")) / F.sum("c")).alias("claims_per_response"),
        F.avg("rate").alias("fabrication_rate"),
        (F.sum("h") / F.sum("c")).alias("hedge_rate"),
        (F.sum("a") / F.sum("c")).alias("abstain_rate"),
        F.try_divide(F.sum("p"), F.sum("np")).alias("mean_position"),
        F.sum("np").alias("n_positions"),
    )


def drift_summary(df: DataFrame) -> DataFrame:
    """Of (uid, task, cond, drift, dperf, er_bin): n, drift rate, mean change of performance by cond, by (cond, task) and by (cond, er_bin), in one pass; level names which."""
    c, t, e = F.col("cond"), F.col("task"), F.col("er_bin")
    out = df.groupingSets([[c], [c, t], [c, e]], c, t, e).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("drift").alias("drift_rate"), F.avg("dperf").alias("mean_dperf"))
    return out.withColumn("level", F.when(F.col("g") == 3, "cond").when(F.col("g") == 1, "task").otherwise("er_bin")).drop("g")


def base_and_perturbed(df: DataFrame, by: list[str], cond: str = "cond") -> DataFrame:
    """Of (uid, base_correct, dperf): per `by` and condition the base rate and the perturbed rate of right answers, over rows that have the condition, and how many."""
    both = df.filter(F.col("dperf").isNotNull())
    return both.groupBy(*by, cond).agg(F.count("*").alias("n"), F.avg("base_correct").alias("base_rate"), F.avg(F.col("base_correct") + F.col("dperf")).alias("perturbed_rate"))


def base_accuracy(df: DataFrame, by: list[str], uid: str = "uid") -> DataFrame:
    """Per `by`: how many distinct uids there are and the share whose base answer is right, each uid once however many conditions it has."""
    return df.groupBy(*by, uid).agg(F.max("base_correct").alias("c")).groupBy(*by).agg(F.count("*").alias("n"), F.avg("c").alias("base_accuracy"))


def draft_coverage(df: DataFrame, by: list[str], uid: str = "uid", drafts: str = "n_draft") -> DataFrame:
    """Per `by`: share of base-correct uids that have a draft."""
    per = df.filter("base_correct = 1").groupBy(*by, uid).agg(F.max(F.col(drafts) > 0).alias("d"))
    return per.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("d").cast("double")).alias("coverage"))


def flip_to_wrong(df: DataFrame, by: list[str], missing: str = "exclude") -> DataFrame:
    """Share of base-correct rows whose performance falls by one. missing: exclude rows without the condition (null dperf), or count them as no_flip."""
    flip = (F.col("dperf") == -1).cast("double")
    flip = F.coalesce(flip, F.lit(0.0)) if missing == "no_flip" else flip
    return df.filter("base_correct = 1").groupBy(*by).agg(F.count(flip).alias("n"), F.avg(flip).alias("flip_rate"))


def saliency_share(df: DataFrame, doc: str, category: str, value: str, by: list[str]) -> DataFrame:
    """Per `by` and category: mean over documents of the category's share of the document's total (total 0 counts as 1), and its token count.

    A document without tokens of a category counts as 0 there.
    """
    per = df.groupBy(*by, doc, category).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    totals = per.groupBy(*by, doc).agg(F.sum("s").alias("t"))
    docs = totals.groupBy(*by).agg(F.count("*").alias("n_docs"))
    shares = per.join(totals, [*by, doc]).withColumn("x", F.col("s") / F.when(F.col("t") == 0, 1.0).otherwise(F.col("t")))
    return shares.groupBy(*by, category).agg(F.sum("x").alias("x"), F.sum("c").alias("count")).join(docs, by).select(*by, category, (F.col("x") / F.col("n_docs")).alias("share"), "count")


def document_shares(df: DataFrame, doc: str, category: str, value: str) -> DataFrame:
    """Per document and category its percentage of the document's total; a total of 0 counts as 1."""
    per = df.groupBy(doc, category).agg(F.sum(value).alias("s"))
    totals = per.groupBy(doc).agg(F.sum("s").alias("t"))
    return per.join(totals, doc).select(doc, category, (100 * F.col("s") / F.when(F.col("t") == 0, 1.0).otherwise(F.col("t"))).alias("percent"))


def skipped_documents(df: DataFrame, by: list[str], too_long: Column, badly_tagged: Column) -> DataFrame:
    """Per `by` over one row per document: how many are kept, too long, or (of the others) badly tagged."""
    why = F.when(F.coalesce(too_long, F.lit(False)), "long").when(F.coalesce(badly_tagged, F.lit(False)), "tags").otherwise("kept")
    return df.groupBy(*by).agg(*[F.count(F.when(why == w, 1)).alias(n) for w, n in (("kept", "n_kept"), ("long", "n_too_long"), ("tags", "n_badly_tagged"))])


def enrichment(df: DataFrame, by: list[str], share_col: str = "share", count: str = "count") -> DataFrame:
    """share over the share of tokens; 0 without tokens."""
    totals = df.groupBy(*by).agg(F.sum(count).alias("_t"))
    ratio = F.col(share_col) / (F.col(count) / F.col("_t"))
    return df.join(totals, by).withColumn("enrichment", F.when(F.col(count) == 0, 0.0).otherwise(F.round(ratio, 6))).drop("_t")


def region_attention(df: DataFrame, by: list[str], regions: list[str]) -> DataFrame:
    """Means of wide per-region columns in long form: by, region, mean, n (nulls left out)."""
    long = df.unpivot(by, regions, "region", "value")
    return long.filter("value IS NOT NULL").groupBy(*by, "region").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def middle_layer(layers: Column) -> Column:
    """Element floor(L / 2), from 0; null for an empty array."""
    return F.get(layers, F.floor(F.size(layers) / 2).cast("int"))


def attention_share(a: Column, b: Column) -> Column:
    """r / (r + 1) of the ratio r = a / b; null if either is 0 or null."""
    r = F.when((a != 0) & (b != 0), a / b)
    return r / (r + 1)


def trace_share(trace: Column, input_: Column, n_trace: Column | None = None, n_input: Column | None = None, eps: float = 1e-9) -> Column:
    """t / (i + t + eps) of two masses; with token counts, of the masses per token. Null masses count as 0."""
    per = lambda x, n: F.coalesce(x, F.lit(0.0)) / (F.greatest(n, F.lit(1)) if n is not None else F.lit(1))
    t, i = per(trace, n_trace), per(input_, n_input)
    return t / (i + t + eps)


def perturbation_delta(df: DataFrame, by: list[str], base: str, perturbed: str) -> DataFrame:
    """Per group the mean of perturbed less base over rows that have both, and how many there are."""
    return df.groupBy(*by).agg(F.avg(F.col(perturbed) - F.col(base)).alias("mean_delta"), F.count(F.col(perturbed) - F.col(base)).alias("n"))


def audit_precision(df: DataFrame, by: list[str]) -> DataFrame:
    """Of (verdict fabricated/verified, label claims/no_claim/unsure): precision among fabricated, verified and both, per `by`; unsure rows are only counted."""
    sure = F.col("label").isin("claims", "no_claim")
    hit = F.when(sure, (F.col("label") == "claims").cast("double"))
    return df.groupBy(*by).agg(
        F.avg(F.when(F.col("verdict") == "fabricated", hit)).alias("fabricated_precision"),
        F.avg(F.when(F.col("verdict") == "verified", hit)).alias("verified_agreement"),
        F.avg(hit).alias("pooled"),
        F.count(hit).alias("n"),
        F.count(F.when(F.col("label") == "unsure", 1)).alias("n_unsure"),
        F.count(F.when(F.col("label").isNull(), 1)).alias("n_unmatched"),
    )


def describe_rates(df: DataFrame, by: list[str], score: str, valid: Column, exact: Column, similarity: list[str], length: Column, cuts: tuple[float, float] = (30.0, 60.0)) -> DataFrame:
    """Per `by`: percentages of valid and exact rows, mean of the first of the similarity columns that df has, mean length, and percentages of scores below, between and from the cuts."""
    x, found = F.col(score), [c for c in similarity if c in df.columns]
    near = F.avg(found[0]) if found else F.lit(None).cast("double")
    bands = {"pct_low": x < cuts[0], "pct_moderate": (x >= cuts[0]) & (x < cuts[1]), "pct_high": x >= cuts[1]}
    return df.groupBy(*by).agg(share(valid).alias("pct_valid"), share(exact).alias("pct_exact"), near.alias("mean_similarity"), F.avg(length).alias("mean_length"), *[share(c).alias(k) for k, c in bands.items()])


def describe_scores(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """n, mean, interpolated median, least, most, population deviation and counts of the three bands. The median is exact (see quantiles)."""
    x = F.col(score)
    rest = df.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.stddev_pop(x).alias("std"),
        F.count(F.when(x < 30, 1)).alias("n_low"),
        F.count(F.when((x >= 30) & (x < 60), 1)).alias("n_moderate"),
        F.count(F.when(x >= 60, 1)).alias("n_high"),
    )
    middle = quantiles(df, by, score, {"median": 0.5}).drop("n")
    out = join_on(rest, middle, by, "left") if by else rest.join(F.broadcast(middle), how="left")  # one row each
    return out.select(*by, "n", "mean", "median", "least", "most", "std", "n_low", "n_moderate", "n_high")


def upper_median(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Element n div 2 (from 0) of the sorted scores."""
    return elements_at(df, by, score, {"upper_median": F.floor(F.col("n") / 2)})


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, as an aggregate over rows that have both; null where one of them does not vary (which corr() answers with an error)."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlate(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*by).agg(F.count("*").alias("n"), correlation(F.col(x), F.col(y)).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def contingency(df: DataFrame, by: list[str]) -> DataFrame:
    """Shares of (exact, fabricating) cells and marginals, with cell 'all' for a marginal; rows without er or exact are left out."""
    marked = df.filter("er IS NOT NULL AND exact IS NOT NULL").select(*by, F.when(F.col("exact"), "right").otherwise("wrong").alias("outcome"), F.when(F.col("er") > 0, "fabricating").otherwise("faithful").alias("trace"))
    b, o, t = [F.col(c) for c in by], F.col("outcome"), F.col("trace")
    cells = marked.groupingSets([[*b, o, t], [*b, o], [*b, t]], *b, o, t).agg(F.count("*").alias("n"))
    totals = marked.groupBy(*by).agg(F.count("*").alias("_t"))
    joined = cells.join(totals, by) if by else cells.join(F.broadcast(totals))
    return joined.select(*by, F.coalesce("outcome", F.lit("all")).alias("outcome"), F.coalesce("trace", F.lit("all")).alias("trace"), "n", (F.col("n") / F.col("_t")).alias("share"))


def group_quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per `by`: n, mean and the three interpolated quartiles of the values, null where there are none."""
    rest = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return join_on(rest, quantiles(df, by, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).drop("n"), by, "left").select(*by, "n", "mean", "q1", "q2", "q3")


def proportion_ci(p: Column, n: Column) -> Column:
    """Half-width of the normal 95 % interval of a proportion."""
    return 1.96 * F.sqrt(p * (1 - p) / n)


def rank_report(df: DataFrame, by: str, score: Column, name: str, n: int = 10) -> DataFrame:
    """The n groups with the highest score, an aggregate, best first and ties by name. A top-k: no group but these is sorted or moved beyond its task."""
    return df.groupBy(by).agg(score.alias(name)).orderBy(F.desc(name), by).limit(n)


def dimension_contributions(df: DataFrame, model: str, task: str, weights: dict[str, float]) -> DataFrame:
    """Per model and dimension: weight times the mean over tasks of the task means, and the total over dimensions."""
    per = df.groupBy(model, task).agg(*[F.avg(k).alias(k) for k in weights])
    means = per.groupBy(model).agg(*[(w * F.avg(k)).alias(k) for k, w in weights.items()])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(k), F.lit(0.0)) for k in weights])
    return means.withColumn("total", total).unpivot([model, "total"], list(weights), "dimension", "contribution")


def heatmap(df: DataFrame, rows: str, cols: str, values: list[str], metric: Column) -> DataFrame:
    """One row per `rows` value and one column per given `cols` value."""
    return df.groupBy(rows).pivot(cols, values).agg(metric)


def check_total(inventory: DataFrame, declared: DataFrame) -> DataFrame:
    """Per experiment of declared(experiment, declared): the sum over tasks of the largest row count of a model, from coverage_inventory, and whether it is the declared one."""
    sums = inventory.groupBy("experiment").agg(F.sum("most").alias("total"))
    rows = declared.join(sums, "experiment", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return rows.withColumn("agrees", F.col("total") == F.col("declared"))


def coverage_inventory(parts: dict[str, DataFrame], model: str, task: str) -> DataFrame:
    """Per task and experiment: distinct models, least and most rows of a model, sorted model names. parts: experiment -> rows."""
    frames = [df.select(F.lit(k).alias("experiment"), F.col(model).cast("string").alias("model"), F.col(task).cast("string").alias("task")) for k, df in parts.items()]
    counts = reduce(DataFrame.unionByName, frames).groupBy("experiment", "task", "model").agg(F.count("*").alias("c"))
    return counts.groupBy("experiment", "task").agg(F.count("*").alias("n_models"), F.min("c").alias("least"), F.max("c").alias("most"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))
