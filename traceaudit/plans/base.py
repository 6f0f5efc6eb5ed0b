"""Registration of queries, and the shapes that they read: each a DataFrame over the given tables and the same view in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceaudit.functions import text as tx
from traceaudit.operators import audit
from traceaudit.operators import claims as cl
from traceaudit.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL. A name is given once."""

    def register(f):
        if (name or f.__name__) in QUERIES:
            raise ValueError(f"there is a query {name or f.__name__!r} already")
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


#: White space for trim() in SQL.
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: A small lexicon of function words in the four languages of the documents; group -> keywords.
LEXICON = {
    "g_the": ("the", "der", "le", "el"),
    "g_and": ("and", "und", "et"),
    "for": ("for",),
    "was": ("was",),
    "with": ("with",),
    "this": ("this", "that"),
    "from": ("from",),
    "by": ("by", "at"),
    "von": ("von",),
    "con": ("con", "del"),
    "pour": ("pour",),
    "que": ("que",),
}
GENERIC = ("g_the", "g_and")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tagged answers to benchmark items: id, doc_id, model, task, question (the text of the next item), gt, answer. The shape of the tags depends on doc_id."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    n = bench.agg(F.count("*").alias("n"))
    keyed = docs.join(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n"))  # one row
    d, t, s = F.col("doc_id") % 10, F.col("text"), F.substring_index("text", ".", 1)
    answer = (
        F.when(d == 0, t)
        .when(d == 1, F.concat(F.lit("<think>"), t, F.lit("</think><answer>draft</answer><answer>"), s, F.lit("</answer>")))
        .when(d == 2, F.concat(F.lit("<|think_start|>"), t, F.lit("<|think_end|><|answer_start|>"), s))
        .when(d == 3, F.lit(""))
        .otherwise(F.concat(F.lit("<think>"), t, F.lit("</think> <answer>"), s, F.lit("</answer>")))
    )
    rows = keyed.withColumn("next_id", (F.col("doc_id") + 1) % F.col("n"))
    rows = rows.join(bench.select("item_id", F.col("text").alias("gt")), "item_id").join(bench.select(F.col("item_id").alias("next_id"), F.col("text").alias("question")), "next_id")
    return rows.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("source").alias("model"), F.col("lang").alias("task"), "question", "gt", answer.alias("answer"))


RESPONSES = """
responses AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source AS model, lang AS task, q.text AS question, b.text AS gt,
    CASE doc_id % 10 WHEN 0 THEN d.text
      WHEN 1 THEN '<think>' || d.text || '</think><answer>draft</answer><answer>' || split_part(d.text, '.', 1) || '</answer>'
      WHEN 2 THEN '<|think_start|>' || d.text || '<|think_end|><|answer_start|>' || split_part(d.text, '.', 1)
      WHEN 3 THEN ''
      ELSE '<think>' || d.text || '</think> <answer>' || split_part(d.text, '.', 1) || '</answer>' END AS answer
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
  JOIN benchmark q ON q.item_id = (d.doc_id + 1) % (SELECT count(*) FROM benchmark))"""


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sql_norm(c: str) -> str:
    return rf"regexp_replace({sql_strip(f'lower({c})')}, '\s+', ' ', 'g')"


SQL_ANSWER = rf"""CASE WHEN contains(answer, '<|answer_start|>') THEN {sql_strip(r"regexp_extract(answer, '(?s)<\|answer_start\|>(.*?)(?:<\|answer_end\|>|\z)', 1)")}
    WHEN regexp_matches(answer, '(?s)<answer>.*?</answer>') THEN {sql_strip("regexp_extract_all(answer, '(?s)<answer>(.*?)</answer>', 1)[-1]")} END"""
SQL_TRACE = rf"""CASE WHEN contains(answer, '<|think_start|>') THEN {sql_strip(r"regexp_extract(answer, '(?s)<\|think_start\|>(.*?)(?:<\|think_end\|>|\z)', 1)")}
    WHEN regexp_matches(answer, '(?s)<think>.*?</think>') THEN {sql_strip("regexp_extract(answer, '(?s)<think>(.*?)</think>', 1)")}
    WHEN regexp_matches(answer, '(?s)^.+?(?:<\|answer_start\|>|<answer>)') THEN {sql_strip(r"regexp_extract(answer, '(?s)^(.+?)(?:<\|answer_start\|>|<answer>)', 1)")} END"""


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """responses with answers, plus pred and trace."""
    return audit.extract(responses(spark, sf_dir))


EXTRACTED = RESPONSES + f""",
extracted AS (SELECT *, {SQL_ANSWER} AS pred, coalesce({SQL_TRACE}, answer) AS trace FROM responses WHERE answer <> '')"""


def sql_groups(c: str, lexicon=None) -> str:
    """Sorted groups named in a normalised text."""
    cases = ", ".join(
        f"CASE WHEN regexp_matches({c}, '(^|[^a-z])({'|'.join(words)})(e?s)?([^a-z]|$)') THEN '{g}' END" for g, words in (lexicon or LEXICON).items()
    )
    return f"list_sort(list_filter([{cases}], lambda x: x IS NOT NULL))"


def evidence() -> Column:
    """Groups in the truth, for English also those in the question."""
    named = {c: cl.named_groups(F.col(c), LEXICON) for c in ("gt", "question")}
    return cl.evidence_for_task(F.col("task"), named, {"en": ("gt", "question")}, ("gt",))


def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extracted with claimed (groups in the trace), evidence, in_gt, verified and fabricated."""
    return audit.verify(extracted(spark, sf_dir), LEXICON, evidence()).withColumn("in_gt", cl.named_groups(F.col("gt"), LEXICON))


CLAIMED = EXTRACTED + f""",
named AS (
  SELECT *, {sql_groups('nt')} AS claimed, {sql_groups('ng')} AS in_gt, {sql_groups('nq')} AS in_question
  FROM (SELECT *, {sql_norm('trace')} AS nt, {sql_norm('gt')} AS ng, {sql_norm('question')} AS nq FROM extracted)),
claimed AS (
  SELECT *, list_sort(list_filter(claimed, lambda x: list_contains(evidence, x))) AS verified,
    list_sort(list_filter(claimed, lambda x: NOT list_contains(evidence, x))) AS fabricated
  FROM (SELECT *, CASE WHEN task = 'en' THEN list_sort(list_distinct(list_concat(in_gt, in_question))) ELSE in_gt END AS evidence FROM named))"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict-like rows from documents and labels: id, doc_id, model, task, exact, er (null without a label), ir, io, eo, n."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        d.cast("string").alias("id"),
        "doc_id",
        F.col("source").alias("model"),
        F.col("lang").alias("task"),
        (F.col("quality") == 1).alias("exact"),
        F.when(F.col("quality").isNotNull(), F.when(d % 3 == 0, 0.0).otherwise((d % 12) * 5.0)).alias("er"),
        ((d % 7) * 4.0).alias("ir"),
        ((d % 11) * 8.0).alias("io"),
        ((d % 5) * 20.0).alias("eo"),
        F.col("n_chars").alias("n"),
    )


VERDICTS = """
verdicts AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source AS model, lang AS task, quality = 1 AS exact,
    CASE WHEN quality IS NOT NULL THEN CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE (doc_id % 12) * 5.0::DOUBLE END END AS er,
    (doc_id % 7) * 4.0::DOUBLE AS ir, (doc_id % 11) * 8.0::DOUBLE AS io, (doc_id % 5) * 20.0::DOUBLE AS eo, n_chars AS n
  FROM documents LEFT JOIN labels USING (doc_id))"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the benchmark items: key (text), item_id, valid, canonical, groups, parts (sentences), fp (positive positions of the embedding of that number)."""
    bench, emb = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    from traceaudit.functions.similarity import on_bits

    fp = emb.select(F.col("vec_id").alias("item_id"), on_bits(F.col("embedding")).alias("fp"))
    parts = F.filter(F.transform(F.split("text", r"\."), tx.normalize_text), lambda s: s != "")
    return bench.join(fp, "item_id", "left").select(
        F.col("text").alias("key"), "item_id", (F.length("text") % 7 != 0).alias("valid"), tx.normalize_text(F.col("text")).alias("canonical"), cl.named_groups(F.col("text"), LEXICON).alias("groups"), parts.alias("parts"), "fp"
    )


FACTS = rf"""
facts AS (
  SELECT text AS key, item_id, length(text) % 7 <> 0 AS valid, {sql_norm('text')} AS canonical, {sql_groups(f"({sql_norm('text')})")} AS groups,
    list_filter(list_transform(string_split(text, '.'), lambda s: {sql_norm('s')}), lambda s: s <> '') AS parts,
    list_filter(list_transform(range(0, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > 0 THEN i END), lambda i: i IS NOT NULL) AS fp
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tokens of documents: doc (user), token_index by time, character range, region, cat, sal, attn."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w, whole = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id")
    i, n = F.col("token_index"), F.col("n_tokens")
    rows = e.withColumn("token_index", (F.row_number().over(w) - 1).cast("long")).withColumn("n_tokens", F.count("*").over(whole))
    region = F.when(i * 3 < n, "input").when(i * 10 >= n * 9, "answer").otherwise("trace")
    return rows.select(F.col("user_id").alias("doc"), "token_index", "n_tokens", (i * 6).alias("char_start"), (i * 6 + 5).alias("char_end"), region.alias("region"), F.col("event_type").alias("cat"), F.col("value").alias("sal"), (F.col("value") % 10).alias("attn"), "event_id")


TOKENS = """
tokens AS (
  SELECT user_id AS doc, token_index, n_tokens, token_index * 6 AS char_start, token_index * 6 + 5 AS char_end,
    CASE WHEN token_index * 3 < n_tokens THEN 'input' WHEN token_index * 10 >= n_tokens * 9 THEN 'answer' ELSE 'trace' END AS region,
    event_type AS cat, value AS sal, value % 10 AS attn, event_id
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS token_index, count(*) OVER (PARTITION BY user_id) AS n_tokens FROM events))"""


def family_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as outcomes: model (return flag), task (nation), family (region), perf, er."""
    li, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    dim = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")
    return li.join(dim, li.l_suppkey == dim.s_suppkey).select(
        F.col("l_returnflag").alias("model"), F.col("n_name").alias("task"), F.col("r_name").alias("family"), (F.col("l_quantity") > 25).cast("double").alias("perf"), F.round(F.col("l_discount") * 100, 6).alias("er"), F.col("l_quantity").alias("length")
    )


FAMILY = """
family_rows AS (
  SELECT l_returnflag AS model, n_name AS task, r_name AS family, CAST(l_quantity > 25 AS DOUBLE) AS perf, round(l_discount * 100, 6) AS er, l_quantity AS length
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def outcomes(spark: SparkSession, sf_dir: str, threshold: float = 30.0) -> DataFrame:
    """Last event of each (user, type) as the outcome of a condition, with the base condition view: uid, task, cond, drift, dperf, base_correct, er, n_draft."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("value", "props"), F.struct("ts", "event_id")).alias("r"))
    rows = last.select(F.col("user_id").alias("uid"), F.col("event_type").alias("cond"), F.floor(F.col("r.value") / 10).alias("answer"), (F.col("r.value") > threshold).cast("int").alias("correct"))
    base = rows.filter("cond = 'view'").select("uid", F.col("answer").alias("base_answer"), F.col("correct").alias("base_correct"))
    d = F.col("uid")
    return rows.filter("cond <> 'view'").join(base, "uid").select(
        "uid", F.when(d % 2 == 0, "translate").otherwise("s2").alias("task"), "cond", (F.col("answer") != F.col("base_answer")).cast("int").alias("drift"), (F.col("correct") - F.col("base_correct")).alias("dperf"), "base_correct",
        F.when(d % 7 != 0, (d % 5) * 10.0).alias("er"), (d % 4).alias("n_draft"),
    )


OUTCOMES = """
last_events AS (SELECT user_id AS uid, event_type AS cond, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL),
conds AS (SELECT uid, cond, floor(value / 10) AS answer, CAST(value > 30 AS INTEGER) AS correct FROM last_events),
outcomes AS (
  SELECT c.uid, CASE WHEN c.uid % 2 = 0 THEN 'translate' ELSE 's2' END AS task, c.cond, CAST(c.answer <> b.answer AS INTEGER) AS drift,
    c.correct - b.correct AS dperf, b.correct AS base_correct, CASE WHEN c.uid % 7 <> 0 THEN (c.uid % 5) * 10.0::DOUBLE END AS er, c.uid % 4 AS n_draft
  FROM conds c JOIN conds b ON b.uid = c.uid AND b.cond = 'view' WHERE c.cond <> 'view')"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as annotations of claims: key, label, annotator, verdict."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    verdict = F.when(F.col("toxic") == 1, "fabricated").otherwise("verified")
    d = F.col("doc_id")
    return rows.select(
        F.concat_ws("|", "source", "lang", d.cast("string"), verdict, F.lit("group")).alias("key"), F.when(d % 17 == 0, "unsure").when(F.col("quality") == 1, "claims").otherwise("no_claim").alias("label"), (d % 2).alias("annotator")
    )


ANNOTATIONS = """
annotations AS (
  SELECT concat_ws('|', source, lang, doc_id, CASE WHEN toxic = 1 THEN 'fabricated' ELSE 'verified' END, 'group') AS key,
    CASE WHEN doc_id % 17 = 0 THEN 'unsure' WHEN quality = 1 THEN 'claims' ELSE 'no_claim' END AS label, doc_id % 2 AS annotator
  FROM labels JOIN documents USING (doc_id))"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn after it: conv_id, turn, question, reply."""
    c = table(spark, sf_dir, "conversations")
    users = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return users.join(replies, ["conv_id", "turn"])


def sql_bleu(source: str, keys: str) -> str:
    """CTEs that end in bleus(keys, bleu2, bleu4), from a source with keys, ref and hyp."""
    word = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
    gram = lambda side: f"SELECT {keys}, k, g, count(*) AS c FROM (SELECT {keys}, k, unnest([array_to_string({side}[i : i + k - 1], ' ') FOR i IN range(1, len({side}) - k + 2)]) AS g FROM bleu_tokens, range(1, 5) o(k)) GROUP BY ALL"
    logs = lambda n: f"exp(sum(ln(greatest(coalesce(h, 0), 0.1) / greatest(1, len(b) - k + 1))) FILTER (k <= {n}) / {n})"
    some = "len(any_value(a)) > 0 AND len(any_value(b)) > 0 AND max(h) FILTER (k = 1) > 0"
    brevity = "CASE WHEN len(any_value(b)) > len(any_value(a)) THEN 1.0 ELSE exp(1 - len(any_value(a)) / len(any_value(b))) END"
    return f"""bleu_tokens AS (SELECT {keys}, regexp_extract_all(coalesce(ref, ''), '{word}') AS a, regexp_extract_all(coalesce(hyp, ''), '{word}') AS b FROM {source}),
  bleu_a AS ({gram("a")}), bleu_b AS ({gram("b")}), bleu_hits AS (SELECT {keys}, k, sum(least(x.c, y.c)) AS h FROM bleu_a x JOIN bleu_b y USING ({keys}, k, g) GROUP BY ALL),
  bleus AS (SELECT {keys}, {", ".join(f"CASE WHEN {some} THEN {brevity} * {logs(n)} ELSE 0.0 END AS bleu{n}" for n in (2, 4))}
    FROM (SELECT * FROM bleu_tokens, range(1, 5) o(k)) LEFT JOIN bleu_hits USING ({keys}, k) GROUP BY {keys})"""


PAIRS = """
turn_pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS reply FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
