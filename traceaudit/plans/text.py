"""Queries: extraction from tagged text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from traceaudit.functions import text as tx
from traceaudit.plans.base import EXTRACTED, RESPONSES, extracted, query, responses, sql_norm, sql_strip
from traceaudit.session import table

ROLE_WORDS = ("this", "von", "pour")


@query(f"WITH {EXTRACTED} SELECT id, model, task, pred FROM extracted")
def x1_extract_answer(spark, d):
    return extracted(spark, d).select("id", "model", "task", "pred")


@query(f"WITH {EXTRACTED} SELECT id, trace, length(trace)::BIGINT AS n FROM extracted")
def x2_extract_reasoning(spark, d):
    return extracted(spark, d).select("id", "trace", F.length("trace").cast("long").alias("n"))


@query(rf"""WITH {EXTRACTED} SELECT id,
  CASE WHEN regexp_matches(answer, '(?s)<answer>.*?</answer>') THEN {sql_strip("regexp_extract(answer, '(?s)<answer>(.*?)</answer>', 1)")} END AS first_pair,
  CASE WHEN contains(answer, '<answer>') THEN {sql_strip("split_part(string_split(answer, '<answer>')[-1], '</answer>', 1)")} END AS after_marker,
  CASE WHEN contains(answer, '</think>') THEN {sql_strip("string_split(answer, '</think>')[-1]")} END AS tail,
  CASE WHEN length(regexp_extract(pred, '^\S+')) BETWEEN 1 AND 999 THEN regexp_extract(pred, '^\S+') END AS token FROM extracted""")
def x3_answer_variants(spark, d):
    a = F.col("answer")
    return extracted(spark, d).select("id", tx.first_answer(a).alias("first_pair"), tx.after_last_marker(a).alias("after_marker"), tx.after_think(a).alias("tail"), tx.answer_token(a).alias("token"))


@query(r"""SELECT event_id, coalesce(TRY_CAST(NULLIF(regexp_extract(a, '<answer>(.*?)</answer>', 1), '') AS DOUBLE), TRY_CAST(regexp_extract_all(a, '[-+]?\d*\.?\d+')[-1] AS DOUBLE)) AS number
  FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '<answer>' || value || '</answer>' ELSE 'about ' || value || ' of ' || event_id END AS a FROM events)""")
def x4_extract_numeric(spark, d):
    v, i = F.col("value").cast("string"), F.col("event_id").cast("string")
    a = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<answer>"), v, F.lit("</answer>"))).otherwise(F.concat(F.lit("about "), v, F.lit(" of "), i))
    return table(spark, d, "events").select("event_id", tx.extract_numeric(a).alias("number"))


@query(rf"""WITH {EXTRACTED} SELECT id,
  CASE WHEN a IS NULL THEN NULL WHEN contains(a, 'yes') THEN 'yes' WHEN contains(a, 'no') THEN 'no' ELSE a END AS label,
  NULLIF(lower(regexp_extract(coalesce(pred, answer), '(?i)\b(the|of)\b', 1)), '') AS word
  FROM (SELECT *, CASE WHEN regexp_matches(answer, '(?s)<answer>.*?</answer>') THEN lower({sql_strip("regexp_extract(answer, '(?s)<answer>(.*?)</answer>', 1)")}) END AS a FROM extracted)""")
def x5_extract_label(spark, d):
    a = F.col("answer")
    return extracted(spark, d).select("id", tx.extract_label(a).alias("label"), tx.extract_whole_word(a, ("the", "of")).alias("word"))


@query(f"SELECT doc_id, md5({sql_norm('text')}) AS digest, length({sql_norm('text')})::BIGINT AS n FROM documents")
def x6_normalize_text(spark, d):
    t = tx.normalize_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@query(f"WITH {RESPONSES} SELECT id, replace(replace(replace(replace(answer, '<|think_start|>', '<think>'), '<|think_end|>', '</think>'), '<|answer_start|>', '<answer>'), '<|answer_end|>', '</answer>') AS markup FROM responses")
def x6_normalize_markup(spark, d):
    return responses(spark, d).select("id", tx.normalize_markup(F.col("answer")).alias("markup"))


@query(r"""SELECT doc_id, md5(CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE text END) AS digest FROM (
  SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda s: NOT (contains(lower(s), 'this') OR contains(lower(s), 'von') OR contains(lower(s), 'pour'))) AS kept FROM documents)""")
def x7_structural_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.structural_sentences(F.col("text"), ROLE_WORDS)).alias("digest"))


FAMILIES = (r"(?i)\b(that|which|from)\b", r"(?i)\b(und nicht|and not|pas de)\b")


@query(rf"""WITH {RESPONSES}, t AS (SELECT *, CASE WHEN regexp_matches(answer, '(?s)<think>.*?</think>') THEN {sql_strip("regexp_extract(answer, '(?s)<think>(.*?)</think>', 1)")} ELSE {sql_strip('answer')} END AS think FROM responses)
  SELECT model, task, count(*) AS n, count(*) FILTER (regexp_matches(think, '{FAMILIES[0]}')) AS n_hedge, count(*) FILTER (regexp_matches(think, '{FAMILIES[1]}')) AS n_abstain FROM t GROUP BY ALL""")
def x13_family_flags(spark, d):
    a = F.col("answer")
    return responses(spark, d).groupBy("model", "task").agg(F.count("*").alias("n"), F.count(F.when(tx.family_flag(a, FAMILIES[0]), 1)).alias("n_hedge"), F.count(F.when(tx.family_flag(a, FAMILIES[1]), 1)).alias("n_abstain"))


@query(rf"""WITH {RESPONSES} SELECT id, regexp_matches(answer, '(?s)<think>.*?</think>\s*<answer>.*?</answer>') AS format_ok,
  CASE WHEN regexp_matches(answer, '(?s)<think>.*?</think>') THEN least(length({sql_strip("regexp_extract(answer, '(?s)<think>(.*?)</think>', 1)")}), 1500) / 1500.0::DOUBLE ELSE 0.0 END AS think_length FROM responses""")
def x14_format_ok(spark, d):
    a = F.col("answer")
    return responses(spark, d).select("id", tx.format_ok(a).alias("format_ok"), tx.think_length(a).alias("think_length"))


@query(f"""WITH {RESPONSES} SELECT id, {sql_strip("CASE WHEN position(m IN gt) > 0 THEN substr(gt, position(m IN gt) + length(m)) ELSE gt END")} AS input
  FROM (SELECT *, CASE task WHEN 'en' THEN ' the ' WHEN 'de' THEN ' der ' WHEN 'fr' THEN ' de ' WHEN 'es' THEN ' que ' END AS m FROM responses)""")
def x15_after_marker(spark, d):
    rows = responses(spark, d)
    marker = F.when(F.col("task") == "en", " the ").when(F.col("task") == "de", " der ").when(F.col("task") == "fr", " de ").when(F.col("task") == "es", " que ")
    return rows.select("id", tx.after_marker(F.col("gt"), marker).alias("input"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS tok FROM documents)
  SELECT cat, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(tok, '^[A-Z]{2,}') THEN 'SMILES_frag' WHEN lower(tok) = 'the' THEN 'FG_word'
    WHEN regexp_matches(tok, '\d') THEN 'position_digit' WHEN regexp_matches(tok, '[A-Za-z]{3,}') THEN 'other_word' ELSE 'punct' END AS cat FROM t) GROUP BY 1""")
def x17_token_category(spark, d):
    tok = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\t\n\f\r ]+"), 0)).alias("tok"))
    return tok.select(tx.token_category(F.col("tok"), F.col("tok").rlike("^[A-Z]{2,}"), F.lower("tok") == "the").alias("cat")).groupBy("cat").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n_alnum, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::BIGINT AS n_distinct,
  len(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''))::BIGINT AS n_blank FROM documents""")
def x18_tokenize(spark, d):
    a, b = tx.tokenize(F.col("text")), tx.tokenize(F.col("text"), "blank")
    return table(spark, d, "documents").select("doc_id", F.size(a).cast("long").alias("n_alnum"), F.size(F.array_distinct(a)).cast("long").alias("n_distinct"), F.size(b).cast("long").alias("n_blank"))


@query("""SELECT split_part(k, '|', 1) AS model, split_part(k, '|', 2) AS task, split_part(k, '|', 3) AS id, split_part(k, '|', 2) || '|' || split_part(k, '|', 3) AS uid
  FROM (SELECT concat_ws('|', source, lang, doc_id) AS k FROM documents)""")
def x19_split_key(spark, d):
    k = table(spark, d, "documents").select(F.concat_ws("|", "source", "lang", F.col("doc_id").cast("string")).alias("k"))
    return k.select(*tx.split_key(F.col("k"), ("model", "task", "id"))).withColumn("uid", F.concat_ws("|", "task", "id"))


@query(r"""SELECT doc_id, len(f)::BIGINT AS n_fragments, array_to_string(list_sort(list_distinct(f)), ' ') AS fragments FROM (
  SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9()=#@+\-\[\]]+'), lambda x: regexp_matches(x, '^[A-Z]{4,}$') AND regexp_matches(x, '[CNO]')) AS f FROM documents)""")
def x11_upper_fragments(spark, d):
    runs = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9()=#@+\-\[\]]+"), 0)
    f = F.filter(runs, lambda x: x.rlike("^[A-Z]{4,}$") & x.rlike("[CNO]"))
    return table(spark, d, "documents").select("doc_id", F.size(f).cast("long").alias("n_fragments"), F.array_join(F.sort_array(F.array_distinct(f)), " ").alias("fragments"))


@query()
def x11_extract_fragments(spark, d):
    f = tx.fragments(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(f).cast("long").alias("n_fragments"), F.array_join(F.sort_array(F.array_distinct(f)), " ").alias("fragments"))


#: Phrasings of edits: (sentence with {a} for the group that goes, {b} for the one that comes and {m} for the molecule, names what goes, names what comes).
EDITS = (
    ("Please substitute a {a} in the molecule {m} with a {b}.", True, True),
    ("Replace the {a} in the molecule {m} by an {b}.", True, True),
    ("Modify the molecule {m} by replacing {a} with {b}", True, True),
    ("Substituting a {a} into {b}.", True, True),
    ("Please add a {b} to the molecule {m}.", False, True),
    ("Adding the {b} in the molecule {m}", False, True),
    ("Remove a {a} from the molecule {m}.", True, False),
    ("Deleting an {a}. Keep {m}.", True, False),
    ("Look at {m}.", False, False),
)


def _sql_edit(name: str, at: int) -> str:
    """The group that a phrasing names, as the operator has to give it."""
    plain = f"CASE WHEN contains({name}, 'benzene') THEN 'benzene_ring' ELSE replace(regexp_replace({name}, 's+$', ''), ' ', '_') END"
    return f"CASE WHEN k IN ({', '.join(str(i) for i, e in enumerate(EDITS) if e[at])}) THEN {plain} END"


@query(f"""WITH c AS (SELECT c_custkey, c_custkey % {len(EDITS)} AS k, 'mono ' || reverse(lower(c_mktsegment)) AS a, CASE WHEN c_custkey % 5 = 0 THEN 'benzene' ELSE lower(c_mktsegment) END AS b FROM customer)
  SELECT c_custkey, {_sql_edit("b", 2)} AS added, {_sql_edit("a", 1)} AS removed FROM c""")
def x16_edit_instruction(spark, d):
    c = table(spark, d, "customer").withColumns({"a": F.concat(F.lit("mono "), F.reverse("c_mktsegment")), "b": F.when(F.col("c_custkey") % 5 == 0, "Benzene").otherwise(F.col("c_mktsegment")), "m": F.lit("CC(=O)N")})
    fill = lambda text: reduce(lambda t, n: F.replace(t, F.lit("{" + n + "}"), F.col(n)), "abm", F.lit(text))
    prose = F.element_at(F.array(*[fill(e[0]) for e in EDITS]), (F.col("c_custkey") % len(EDITS) + 1).cast("int"))
    return c.withColumn("e", tx.edit_instruction(prose)).select("c_custkey", "e.added", "e.removed")
