"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

A rule reads a few measures of a text and rejects it or not. A measure is computed when a rule first asks for it and then kept, so
rules share what they have in common (the words of a text, say). On a bounded sample every measure of every text is timed and every
rule is applied. From that the cascade is put together greedily: next comes the rule with the most rejections among the texts that
are left per second of the measures that it adds for them, so both overlap of rules and shared measures count. Over all documents
the rules then run in this order, and a text is done with at the first that rejects it. The order decides the cost and never the verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.common import WordHashes, pieces_of, shingle_hashes
from traceaudit.session import table

#: Documents of the sample that costs and rejections are estimated on, at most.
SAMPLE_ROWS = 2_000
#: Rows of an Arrow batch that are Python objects at once.
ROWS = 64
#: White space, symbols, words of a window.
BLANKS, SYMBOLS, WINDOW = " \t\n\v\f\r", "#*$%&|<>", 8

_HASHES = WordHashes()


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that stand in a window of `width` words which the text has twice or more. Hashes name the candidates, the words decide."""
    if len(words) <= width:
        return 0
    keys = shingle_hashes(_HASHES.of(words), width)
    _, which, n = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[which] > 1).tolist()
    seen = Counter(tuple(words[i : i + width]) for i in starts)
    marks = np.zeros(len(words) + 1, np.int64)
    for i in starts:
        if seen[tuple(words[i : i + width])] > 1:
            marks[i] += 1
            marks[i + width] -= 1
    return int((np.cumsum(marks[:-1]) > 0).sum())


@dataclass(frozen=True)
class Measure:
    """A value of a text, computed from the text ('text') and other measures."""

    parts: tuple[str, ...]
    of: Callable


MEASURES = {
    "words": Measure(("text",), lambda text: text.encode("utf-8", "surrogatepass").split()),
    "n_words": Measure(("words",), len),
    "word_chars": Measure(("text",), lambda text: len(text) - sum(map(text.count, BLANKS))),
    "n_symbols": Measure(("text",), lambda text: sum(map(text.count, SYMBOLS))),
    "lines": Measure(("text",), lambda text: [line for line in text.split("\n") if line.strip(BLANKS)]),
    "n_lines": Measure(("lines",), len),
    "n_dup_lines": Measure(("lines",), lambda lines: len(lines) - len(set(lines))),
    "n_repeat_words": Measure(("words",), repeat_words),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text by some of its measures."""

    name: str
    measures: tuple[str, ...]
    rejects: Callable[..., bool]


#: The two rules that every use has, and the method's own: words of odd length, many symbols, many repeated lines (more than three, as short texts have few).
BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
)
RULES = (
    *BASE,
    Rule("odd_words", ("word_chars", "n_words"), lambda c, n: c < 2 * n or c > 15 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 100 * s > 10 * n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: d > 3 and 100 * d > 30 * n),
)


class Text(dict):
    """The measures of a text by name, each computed when it is first asked for."""

    def __init__(self, text: str | None, measures: dict[str, Measure]):
        self["text"], self.measures = text or "", measures

    def __missing__(self, name: str):
        m = self.measures[name]
        value = self[name] = m.of(*[self[p] for p in m.parts])
        return value

    def rejected_by(self, rule: Rule) -> bool:
        return bool(rule.rejects(*[self[m] for m in rule.measures]))


class TimedText(Text):
    """Also keeps the seconds of each measure, without those of its parts."""

    def __init__(self, text: str | None, measures: dict[str, Measure]):
        super().__init__(text, measures)
        self.seconds: dict[str, float] = {}

    def __missing__(self, name: str):
        for p in self.measures[name].parts:
            self[p]
        began = time.perf_counter()
        value = super().__missing__(name)
        self.seconds[name] = time.perf_counter() - began
        return value


def closure(names: Sequence[str], measures: dict[str, Measure] = MEASURES) -> set[str]:
    """These measures and all that they are computed from."""
    found: set[str] = set()
    for name in names:
        if name != "text" and name not in found:
            found |= {name} | closure(measures[name].parts, measures)
    return found


def estimates(sample: DataFrame, rules: Sequence[Rule] = RULES, measures: dict[str, Measure] = MEASURES) -> DataFrame:
    """rejected array<boolean> (by rule) and seconds array<double> (by measure, in the order of `measures`) of each row of sample(text)."""

    def run(batches):
        for batch in pieces_of(batches, ROWS):
            rejected, seconds = [], []
            for text in batch.column(0).to_pylist():
                t = TimedText(text, measures)
                rejected.append([t.rejected_by(r) for r in rules])
                seconds.append([t.seconds.get(m, 0.0) for m in measures])
            yield pa.RecordBatch.from_arrays([pa.array(rejected, pa.list_(pa.bool_())), pa.array(seconds, pa.list_(pa.float64()))], ["rejected", "seconds"])

    return sample.select("text").mapInArrow(run, "rejected array<boolean>, seconds array<double>")


def best_order(rejected: np.ndarray, seconds: np.ndarray, rules: Sequence[Rule] = RULES, measures: dict[str, Measure] = MEASURES) -> list[tuple[Rule, float, float]]:
    """The cascade, greedily: (rule, share of the texts left that it rejects, seconds a text that it adds). Ties keep the order of `rules`.

    rejected: texts x rules; seconds: texts x measures. Without texts the rules stay as they are.
    """
    left, known, at, out = np.ones(len(rejected), bool), set(), {m: i for i, m in enumerate(measures)}, []
    todo = list(range(len(rules)))
    while todo:
        n = max(1, int(left.sum()))

        def gain(r: int, n=n) -> tuple[float, float]:
            new = [at[m] for m in closure(rules[r].measures, measures) - known]
            return float(rejected[left, r].sum()) / n, float(seconds[left][:, new].sum()) / n

        scored = [(r, *gain(r)) for r in todo]
        r, share, cost = max(scored, key=lambda x: (x[1] / max(x[2], 1e-9), -x[0]))
        out.append((rules[r], share, cost))
        todo.remove(r)
        known |= closure(rules[r].measures, measures)
        left &= ~rejected[:, r]
    return out


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, measures: dict[str, Measure] = MEASURES, most: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The order of the rules for docs(doc_id, text), estimated on the `most` documents whose ids come first in hash order.

    Of the sample a few numbers a row reach the driver, `most` rows at most; the ids that pick it are broadcast.
    """
    first = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = estimates(docs.select("doc_id", "text").join(F.broadcast(first), "doc_id"), rules, measures).limit(most).collect()
    rejected = np.array([r["rejected"] for r in rows], bool).reshape(len(rows), len(rules))
    return best_order(rejected, np.array([r["seconds"] for r in rows]).reshape(len(rows), len(measures)), rules, measures)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, report: Sequence[str] = (), measures: dict[str, Measure] = MEASURES) -> DataFrame:
    """doc_id, kept boolean, and the measures named in `report` (long) for each row of docs(doc_id, text).

    kept: no rule rejects the text. Only measures of `report` are computed beyond what the cascade needs. A null text is empty; a null or
    repeated doc_id gives one result for each of its rows; other columns are ignored; an empty table gives no rows.
    """
    order = [rule for rule, _, _ in plan(docs, rules, measures)]

    def run(batches):
        for batch in pieces_of(batches, ROWS):
            kept, values = [], {m: [] for m in report}
            for text in batch.column(1).to_pylist():
                t = Text(text, measures)
                kept.append(not any(map(t.rejected_by, order)))
                for m in report:
                    values[m].append(t[m])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.bool_()), *[pa.array(v, pa.int64()) for v in values.values()]], ["doc_id", "kept", *report])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {ids}", "kept boolean", *[f"{m} long" for m in report]]))


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, measures: dict[str, Measure] = MEASURES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns; nothing is measured beyond a text's first rejection."""
    order = [rule for rule, _, _ in plan(docs, rules, measures)]
    at = docs.columns.index("text")

    def run(batches):
        for batch in pieces_of(batches, ROWS):
            yield batch.filter(pa.array([not any(map(Text(text, measures).rejected_by, order)) for text in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op11_rule_cascade(spark, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    judged = judge(table(spark, sf_dir, "documents"), report=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i - 1 AS place, w[i : i + 7] AS gram FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT r, unnest(list(place)) AS place FROM g GROUP BY r, gram HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT place + k) AS n FROM twice, range(8) AS x(k) GROUP BY r),
ln AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM ln GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0) AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN l USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * n_symbols > 10 * n_words OR n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines) AS kept
FROM m
"""
