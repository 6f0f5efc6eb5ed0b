"""LM scoring with a Katz backoff trigram model over words, trained and applied without joining token by token.

The texts are cut into batches of token ids that stay where they are. What travels are, for each batch, its distinct 1-, 2- and
3-grams as sorted hashes with training counts, in slices by hash range (the partitioned tables of the model, one for each
order); a range adds up what all batches have of it and sends each batch its totals back. With its totals, a batch scores its
own tokens, longest n-gram first. A key with a third of all tokens is one entry per batch, so no key is hot. Backoff
weights are made the same way: each history's sums meet in its range, and each batch that needs its weight gets it back once.

Probabilities, with counts c over the training tokens and a history h of one or two words, h' the same without its first word:

* P(w | h) = d(c(hw)) c(hw) / c(h) where hw was seen, else alpha(h) P(w | h'), or P(w | h') itself where h was not seen;
* P(w) = d(c(w)) c(w) / N; what discounting leaves is the probability of one unknown word that stands for all others;
* d: Good-Turing discounts of each order up to a count of 5, where they lie inside (0, 1), else (r - 0.5) / r. Katz leaves counts above 5
  whole; here (r - 0.5) / r stands there too, as a history whose counts are all above 5 would leave unseen words probability 0;
* alpha(h) = (1 - sum of P(w | h) over w seen after h) / (1 - sum of P(w | h') over the same w), which makes P(. | h) sum to 1.

train() writes the model as tables, partitioned by order: the n-grams of each range with their counts, and the sums that give each history its weight.
score_with() scores any texts by such a model, which takes the place of the batches that were trained on. score_texts() does both for one table of texts at once
and keeps only the weights that its own texts need.

A text begins after a start mark, a history only, and ends with an end token. Its first token has the start mark alone as history.

Words are told apart by 64-bit hashes, whatever the size. Of the hashes of 2- and 3-grams, which are most of what travels, SPARE_BITS bits more are kept than the
number of tokens has, 64 at most, so that the chance that an n-gram is taken for another stays the same at every size.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.common import cut, in_runs, mix64, pack_sorted, pieces_of, planes, slices_of, sorted_runs, unpack_sorted, unplanes, words_of
from traceaudit.llm.labelled import crc_remainder
from traceaudit.session import table

#: Tokens of one batch of texts (a longer text is a batch of its own), and hashes of one range, about.
BATCH_TOKENS = 1_200_000
RANGE_KEYS = 2_000_000
SPARE_BITS = 20
#: Counts up to this are discounted by Good-Turing.
GT_MOST = 5
#: Rows that are Python objects at once in a task.
TASK_ROWS = 1000
#: Hashes of the end token and of the start mark.
END, START = np.uint64(0x9E6C63D0876A9A47), np.uint64(0x5851F42D4C957F2D)
BATCHES = "batch long, doc_ids array<long>, train array<boolean>, lens array<int>, stream binary, words binary, ranks binary"
SENT = "kind int, slice long, batch long, keys binary, counts binary, others binary"
TOTALS = "batch long, kind int, slice long, totals binary, owned binary, asked binary, stats array<long>, keys binary, counts binary"
#: Stands for the batch in rows of a stored model.
MODEL = -1
SCORED = "batch long, kind int, slice long, turn int, hists binary, sums binary, lower binary, c binary, c_lower binary, needs binary, doc_ids array<long>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>"
REPLY = "batch long, kind int, slice long, alphas binary, needs binary, doc_ids array<long>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>"


def pack(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def packed(a: np.ndarray) -> bytes:
    """Compressed planes of an array, with its length in front."""
    data = planes(a)
    return len(data).to_bytes(8, "little") + pack(data)


def unpacked(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return unplanes(pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b"", kind)


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def flags_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class LocalIds(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 2
        return n


def text_batches(docs: DataFrame, batch_tokens: int) -> DataFrame:
    """Texts of docs(doc_id, text, train) as batches: word ids of the batch by falling frequency, with an end token after each text, and the hash of each id's word."""

    def run(batches):
        state: list = [[], [], [], [], LocalIds(), 0]

        def flush():
            ids, train, lens, streams, vocabulary, _ = state
            words = np.concatenate([np.array([END, START], np.uint64), np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))])
            stream = np.concatenate(streams)
            number = np.empty(len(words), np.int32)
            number[np.argsort(-np.bincount(stream, minlength=len(words)), kind="stable")] = np.arange(len(words), dtype=np.int32)
            order = np.argsort(words, kind="stable")
            row = {"batch": uuid.uuid4().int >> 65, "doc_ids": ids, "train": train, "lens": lens, "stream": packed(number[stream]), "words": packed_keys(words[order]), "ranks": packed(number[order])}
            state[:] = [[], [], [], [], LocalIds(), 0]
            return record([row], BATCHES)

        for batch in pieces_of(batches, TASK_ROWS):
            for doc, text, train in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = words_of(text)
                if state[5] and state[5] + len(words) > batch_tokens:
                    yield flush()
                ids = np.zeros(len(words) + 1, np.int32)  # 0, the end, stands last
                ids[:-1] = np.fromiter(map(state[4].__getitem__, words), np.int32, len(words))
                for held, value in zip(state, (doc, train, len(ids), ids), strict=False):
                    held.append(value)
                state[5] += len(ids)
        if state[0]:
            yield flush()

    return docs.select("doc_id", "text", "train").mapInArrow(run, BATCHES)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of each key among them, and the place of one occurrence of each."""
    if not len(keys):
        return keys, np.empty(0, np.int32), np.empty(0, np.int64)
    order = np.argsort(keys)
    found = keys[order]
    new = np.concatenate([[True], found[1:] != found[:-1]])
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return found[new], inverse, order[new]


class Batch:
    """A batch of texts: its word hashes, and each token with the word before it."""

    def __init__(self, row: dict, width: int):
        self.row, self.cutoff = row, np.uint64(64 - width)
        self.lens = np.array(row["lens"], np.int64)
        self.train = np.repeat(np.array(row["train"], bool), self.lens)
        words = unpacked_keys(row["words"])
        ranks = unpacked(row["ranks"], np.int32)
        self.words = np.empty_like(words)
        self.words[ranks] = words
        self.order = ranks  # ids by hash
        self.stream = unpacked(row["stream"], np.int32)
        self.start = int(np.flatnonzero(self.words == START)[0])
        self.first = np.zeros(len(self.stream), bool)  # tokens that begin a text
        self.first[np.cumsum(self.lens) - self.lens] = True
        self.hist = np.empty_like(self.stream)
        self.hist[1:] = self.stream[:-1]
        self.hist[self.first] = self.start

    def unigrams(self):
        """(keys, training counts, other counts) by key; the start mark counts the texts."""
        n = len(self.words)
        seen, both = np.bincount(self.stream[self.train], minlength=n), np.bincount(self.stream, minlength=n)
        firsts = np.array(self.row["train"], bool)
        seen[self.start], both[self.start] = firsts.sum(), len(firsts)
        return self.words[self.order], seen[self.order], (both - seen)[self.order]

    def grams(self):
        """distinct() of the 2-grams of all tokens, and of the 3-grams of all tokens but the first of each text."""
        base = np.uint64(0x9E3779B97F4A7C15)
        two = mix64(mix64(self.words)[self.hist] * base + self.words[self.stream])
        at = np.flatnonzero(~self.first)
        three = mix64(two[at - 1] * base + self.words[self.stream[at]] + np.uint64(1))
        return [distinct(g >> self.cutoff << self.cutoff) for g in (two, three)]


def record(rows: list[dict], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64())}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in fields], schema=pa.schema(fields))


def one_by_one(batches):
    """Rows of the batches as dicts, one at a time, as they are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def runs_of(batches, keys: tuple[str, ...]):
    """Rows with equal keys, from batches sorted by them."""
    held, key = [], None
    for row in one_by_one(batches):
        now = tuple(row[k] for k in keys)
        if now != key and held:
            yield held
            held = []
        key = now
        held.append(row)
    if held:
        yield held


def send_counts(width: int, bits: int, ask_all: bool = False):
    """Distinct n-grams of each batch with training counts. others: which ones texts outside the training set have; all of them with ask_all."""

    def run(batches):
        for row in one_by_one(batches):
            b = Batch(row, width)
            tables = [(1, *b.unigrams())]
            for kind, (keys, inverse, _) in zip((2, 3), b.grams(), strict=True):
                train = b.train if kind == 2 else b.train[~b.first]
                counts = np.bincount(inverse[train], minlength=len(keys))
                tables.append((kind, keys, counts, np.bincount(inverse, minlength=len(keys)) - counts))
            for kind, keys, n, other in tables:
                for s, lo, hi in slices_of(keys, bits):
                    others = np.packbits((other[lo:hi] > 0) | ask_all).tobytes() if kind < 3 else None
                    yield record([{"kind": kind, "slice": s, "batch": row["batch"], "keys": packed_keys(keys[lo:hi]), "counts": packed(n[lo:hi].astype(np.int32)), "others": others}], SENT)

    return run


def add_up(start: np.uint64, keep: bool = False):
    """Totals of each range for each batch in it, and with keep also all of its trained n-grams with their counts, as a row of batch MODEL. owned: which keys this batch is the one to speak for; asked: which ones texts outside the training set have.
    stats, on one row of a range: how many keys have count 1 .. GT_MOST + 1, any count, and the sum of counts."""

    def run(batches):
        for rows in runs_of(batches, ("kind", "slice")):
            kind = rows[0]["kind"]
            keys = [unpacked_keys(r["keys"]) for r in rows]
            counts = np.concatenate([unpacked(r["counts"], np.int64 if r["batch"] == MODEL else np.int32) for r in rows])
            every, inverse, _ = distinct(np.concatenate(keys))
            total = np.bincount(inverse, counts, minlength=len(every)).astype(np.int64)
            owner = np.full(len(every), -1, np.int64)
            trained = np.flatnonzero(counts > 0)[::-1]
            owner[inverse[trained]] = trained
            owned = owner[inverse] == np.arange(len(inverse))
            asked = None
            if kind < 3:
                others = [flags_of(r["others"], len(k)) if r["others"] is not None else np.zeros(len(k), bool) for r, k in zip(rows, keys, strict=True)]
                asked = np.bincount(inverse, np.concatenate(others), minlength=len(every))[inverse] > 0
            counted = total[every != start] if kind == 1 else total
            stats = [*(int((counted == r).sum()) for r in range(1, GT_MOST + 2)), int((counted > 0).sum()), int(counted.sum())]
            if keep:
                held = total > 0
                yield record([{"batch": MODEL, "kind": kind, "slice": rows[0]["slice"], "keys": packed_keys(every[held]), "counts": packed(total[held])}], TOTALS)
            at = 0
            for r, k in zip(rows, keys, strict=True):
                mine = slice(at, at + len(k))
                at += len(k)
                if r["batch"] == MODEL:
                    continue
                out = {"batch": r["batch"], "kind": kind, "slice": r["slice"], "totals": packed(total[inverse[mine]]), "owned": np.packbits(owned[mine]).tobytes(), "stats": stats}
                yield record([out | {"asked": None if asked is None else np.packbits(asked[mine]).tobytes()}], TOTALS)
                stats = None

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Kept share d(r) of the counts r = 1 .. GT_MOST, from how many keys have count 1 .. GT_MOST + 1."""
    half = np.array([(r - 0.5) / r for r in range(1, GT_MOST + 1)])
    if n[0] == 0 or 0 in n:
        return half
    common = (GT_MOST + 1) * n[GT_MOST] / n[0]
    with np.errstate(all="ignore"):
        d = np.array([((r + 1) * n[r] / (n[r - 1] * r) - common) / (1 - common) for r in range(1, GT_MOST + 1)])
    return np.where(np.isfinite(d) & (d > 0) & (d < 1), d, half)


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) * c for an array of counts."""
    c = c.astype(np.float64)
    small = np.clip(c, 1, GT_MOST).astype(np.int64) - 1
    return np.where(c > GT_MOST, c - 0.5, np.where(c > 0, d[small] * c, 0.0))


def unigram_counts(c: np.ndarray, d: np.ndarray, kept: float, n: int) -> np.ndarray:
    """N * P(w) of words with count c; kept: the sum of all discounted counts. Count 0 gets what is left, as one unknown word."""
    return np.where(c > 0, discounted(c, d), n - kept)


def score_batches(model: dict, width: int, bits: int):
    d1, d2, d3, n, v, kept = (model[k] for k in ("d1", "d2", "d3", "n", "v", "kept"))

    def own_sums(batch, order, hists, mine, x, y, c, c_lower):
        """Rows of what this batch's own n-grams add to their histories: hists, the key of each token's history; mine: tokens of own n-grams."""
        keys, inverse, one = distinct(hists[mine])
        sums = [np.bincount(inverse, values[mine], minlength=len(keys)) for values in (x, y)]
        at = mine[one]
        for s, lo, hi in slices_of(keys, bits):
            part = slice(lo, hi)
            yield record([{"batch": batch, "kind": order, "slice": s, "turn": 0, "hists": packed_keys(keys[part]), "sums": packed(sums[0][part]), "lower": packed(sums[1][part]), "c": packed(c[at[part]]), "c_lower": packed(c_lower[at[part]])}], SCORED)

    def run(batches):
        for rows in runs_of(batches, ("batch",)):
            b, batch = Batch(rows[0], width), rows[0]["batch"]
            total, owned, asked = {}, {}, {}
            for k in (1, 2, 3):
                parts = [r for r in rows[1:] if r["kind"] == k]
                arrays = [unpacked(r["totals"], np.int64) for r in parts]
                join = lambda field, parts=parts, arrays=arrays: np.concatenate([np.empty(0, bool), *[flags_of(r[field], len(a)) for r, a in zip(parts, arrays, strict=True)]])
                total[k] = np.concatenate([np.empty(0, np.int64), *arrays])
                owned[k], asked[k] = join("owned"), join("asked") if k < 3 else None
            del rows[1:]
            c1, asked1 = np.empty(len(b.words), np.int64), np.empty(len(b.words), bool)
            c1[b.order], asked1[b.order] = total[1], asked[1]
            u1 = unigram_counts(c1, d1, kept, n)
            p1 = u1 / n if n else np.ones(len(c1))
            (keys2, inverse2, one2), (_, inverse3, one3) = b.grams()
            later = np.flatnonzero(~b.first)
            c2, c3 = total[2][inverse2], np.zeros(len(b.stream), np.int64)
            c3[later] = total[3][inverse3]
            ch2 = np.zeros(len(b.stream), np.int64)
            ch2[later] = c2[later - 1]  # of the two words before a token
            c, ch1 = c1[b.stream], c1[b.hist]
            base = np.log10((c + 1) / (n + 1 * (v + 1)))
            k2, k3 = discounted(c2, d2), discounted(c3, d3)
            with np.errstate(divide="ignore", invalid="ignore"):
                lower = np.where(c2 > 0, np.log10(k2 / ch1), np.log10(p1[b.stream]))
                score = np.where(c3 > 0, np.log10(k3 / ch2), lower)
            doc = np.repeat(np.arange(len(b.lens), dtype=np.int32), b.lens)
            per_doc = lambda x: np.bincount(doc, x, minlength=len(b.lens))  # noqa: B023, E731
            hist2 = np.zeros(len(b.stream), np.uint64)
            hist2[later] = keys2[inverse2[later - 1]]
            needs = []
            for order, hists, need in ((2, b.words[b.hist], (c3 == 0) & (c2 == 0) & (ch1 > 0)), (3, hist2, (c3 == 0) & (ch2 > 0))):
                at = np.flatnonzero(need)
                keys, inverse, _ = distinct(hists[at])
                wanted, times = np.unique(inverse.astype(np.int64) * len(b.lens) + doc[at], return_counts=True)
                needs.append(b"".join(len(x).to_bytes(8, "little") + x for x in (packed(np.diff(wanted // len(b.lens), prepend=0).astype(np.int32)), packed((wanted % len(b.lens)).astype(np.int32)), packed(times.astype(np.int32)))))
                for s, lo, hi in slices_of(keys, bits):
                    yield record([{"batch": batch, "kind": order, "slice": s, "turn": 1, "hists": packed_keys(keys[lo:hi])}], SCORED)
            own = one2[owned[2]]  # one token of each 2-gram that this batch speaks for
            yield from own_sums(batch, 2, b.words[b.hist], own[asked1[b.hist[own]]], k2, u1[b.stream], ch1, np.full(len(b.stream), n, np.int64))
            own = later[one3[owned[3]]]
            yield from own_sums(batch, 3, hist2, own[asked[2][inverse2[own - 1]]], k3, k2, ch2, ch1)
            yield record(
                [{"batch": batch, "kind": 0, "slice": batch, "turn": 0, "needs": len(needs[0]).to_bytes(8, "little") + needs[0] + needs[1], "doc_ids": b.row["doc_ids"], "n_tokens": b.lens, "n_known": per_doc(c > 0).astype(np.int64), "base": per_doc(base), "score": per_doc(score)}],
                SCORED,
            )

    return run


def back_off(batches):
    """Rows of kind 0 as they are, and for each batch that needs weights of a range the log10 alpha of its histories there, in their order."""
    for rows in runs_of(batches, ("kind", "slice")):
        if rows[0]["kind"] == 0:
            for r in rows:
                yield record([r], REPLY)
            continue
        own, need = ([r for r in rows if r["turn"] == t] for t in (0, 1))
        if not need:
            continue
        every, inverse, first = distinct(np.concatenate([unpacked_keys(r["hists"]) for r in own]))
        x, y = (np.bincount(inverse, np.concatenate([unpacked(r[f], np.float64) for r in own])) for f in ("sums", "lower"))
        c, c_lower = (np.concatenate([unpacked(r[f], np.int64) for r in own])[first] for f in ("c", "c_lower"))
        alpha = np.log10((1 - x / c) / (1 - y / c_lower)).astype(np.float32)
        for r in need:
            at = np.searchsorted(every, unpacked_keys(r["hists"]))
            yield record([{"batch": r["batch"], "kind": r["kind"], "slice": r["slice"], "alphas": packed(alpha[at])}], REPLY)


def finish(batches):
    """One row per text: the scores of its batch plus the weights that it needs."""
    for rows in runs_of(batches, ("batch",)):
        r, score = rows[0], np.array(rows[0]["score"])
        data, of_two = r["needs"], int.from_bytes(r["needs"][:8], "little")
        for order, part in ((2, data[8 : 8 + of_two]), (3, data[8 + of_two :])):
            arrays, at = [], 0
            for _ in range(3):
                size = int.from_bytes(part[at : at + 8], "little")
                arrays.append(unpacked(part[at + 8 : at + 8 + size], np.int32))
                at += 8 + size
            hist, doc, times = np.cumsum(arrays[0], dtype=np.int64), arrays[1], arrays[2]
            alphas = np.concatenate([np.empty(0, np.float32), *[unpacked(x["alphas"], np.float32) for x in rows[1:] if x["kind"] == order]]).astype(np.float64)
            score += np.bincount(doc, alphas[hist] * times, minlength=len(score))
        columns = {"doc_id": pa.array(r["doc_ids"], pa.int64()), "n_tokens": pa.array(r["n_tokens"]), "n_known": pa.array(r["n_known"]), "base_score": pa.array(r["base"]), "score": pa.array(score)}
        yield pa.RecordBatch.from_pydict(columns)


def hash_width(docs: DataFrame) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    return min(64, max(40, int(size).bit_length() + SPARE_BITS - 2))  # a token takes some four to eight bytes


def batches_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """The texts as written batches, and how many tokens they have."""
    parts = cut(text_batches(docs, BATCH_TOKENS), "katz-batches")
    return parts, parts.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0


def totals_of(sent: DataFrame, keep: bool = False) -> DataFrame:
    return cut(in_runs(sent, ["kind", "slice"], ["kind", "slice"]).mapInArrow(add_up(START, keep), TOTALS), "katz-totals")


def parameters(totals: DataFrame) -> dict:
    """Token and word counts and the discounts of each order, from the statistics of the ranges."""
    n_stats = GT_MOST + 3
    sums = {r["kind"]: [int(r[f"s{i}"]) for i in range(n_stats)] for r in totals.filter("stats IS NOT NULL").groupBy("kind").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n_stats)]).collect()}
    one, two, three = (sums.get(k, [0] * n_stats) for k in (1, 2, 3))
    d1, n, v = discounts(one[: GT_MOST + 1]), one[-1], one[-2]
    above = (n - sum(r * one[r - 1] for r in range(1, GT_MOST + 1)), v - sum(one[:GT_MOST]))
    kept = float(sum(d1[r - 1] * r * one[r - 1] for r in range(1, GT_MOST + 1)) + above[0] - 0.5 * above[1])
    return {"d1": d1, "d2": discounts(two[: GT_MOST + 1]), "d3": discounts(three[: GT_MOST + 1]), "n": n, "v": v, "kept": kept}


def scored_batches(parts: DataFrame, totals: DataFrame, model: dict, width: int, bits: int) -> DataFrame:
    """Rows of SCORED: each batch meets its totals."""
    left = parts.withColumns({"kind": F.lit(0), "slice": F.lit(0).cast("long"), **{c: F.lit(None).cast("binary") for c in ("totals", "owned", "asked")}})
    right = totals.filter(F.col("batch") != MODEL).drop("stats", "keys", "counts").withColumns({c: F.lit(None).cast(t) for c, t in parts.dtypes if c != "batch"}).select(left.columns)
    both = in_runs(left.union(right), ["batch"], ["batch", "kind", "slice"])
    return both.mapInArrow(score_batches(model, width, bits), SCORED)


def texts_of(scored: DataFrame, n: int) -> DataFrame:
    """One row per text: its batch's scores with the backoff weights of the ranges."""
    replies = in_runs(scored, ["kind", "slice"], ["kind", "slice", "turn"]).mapInArrow(back_off, REPLY)
    rows = in_runs(replies, ["batch"], ["batch", "kind", "slice"]).mapInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def range_bits(tokens: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, tokens / RANGE_KEYS)))))


def score_texts(docs: DataFrame) -> DataFrame:
    """Train on docs(doc_id, text, train) where train is true, and score all: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end; a null or empty text is an end alone. base_score is the sum of
    log10((c + 1) / (N + V + 1)), score the log10 probability of the text. Rows may repeat; one row comes back for each, and other columns are
    ignored. A null train counts as false. Without training texts every probability is that of the one unknown word, 1.
    """
    docs = docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train"))
    width = hash_width(docs)
    parts, tokens = batches_of(docs)
    bits = range_bits(tokens)
    totals = totals_of(parts.mapInArrow(send_counts(width, bits), SENT))
    model = parameters(totals)
    return texts_of(scored_batches(parts, totals, model, width, bits), model["n"])


def train(docs: DataFrame, path: str) -> None:
    """Write the model of docs(text) to a new folder that all executors share: grams and sums, both partitioned by kind (the order), and parameters.

    Null and empty texts count as ends alone. All weights are kept, not only those that some text needs.
    """
    docs = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("train"))
    width = hash_width(docs)
    parts, tokens = batches_of(docs)
    bits = range_bits(tokens)
    totals = totals_of(parts.mapInArrow(send_counts(width, bits, ask_all=True), SENT), keep=True)
    model = parameters(totals)
    totals.filter(F.col("batch") == MODEL).select("kind", "slice", "keys", "counts").write.partitionBy("kind").parquet(f"{path}/grams")
    sums = scored_batches(parts, totals, model, width, bits).filter("kind > 0 AND turn = 0")
    sums.select("kind", "slice", "hists", "sums", "lower", "c", "c_lower").write.partitionBy("kind").parquet(f"{path}/sums")
    row = [(width, bits, model["n"], model["v"], model["kept"], *[model[k].tolist() for k in ("d1", "d2", "d3")])]
    docs.sparkSession.createDataFrame(row, "width int, bits int, n long, v long, kept double, d1 array<double>, d2 array<double>, d3 array<double>").write.parquet(f"{path}/parameters")


def score_with(docs: DataFrame, path: str) -> DataFrame:
    """Score docs(doc_id, text) by the model that train() wrote to path; the columns are those of score_texts."""
    spark = docs.sparkSession
    held = spark.read.parquet(f"{path}/parameters").first()
    model = {**{k: np.array(held[k]) for k in ("d1", "d2", "d3")}, **{k: held[k] for k in ("n", "v", "kept")}}
    parts, _ = batches_of(docs.select("doc_id", "text", F.lit(False).alias("train")))
    grams = spark.read.parquet(f"{path}/grams")
    known = grams.select(F.col("kind").cast("int").alias("kind"), "slice", F.lit(MODEL).cast("long").alias("batch"), "keys", "counts", F.lit(None).cast("binary").alias("others"))
    totals = totals_of(parts.mapInArrow(send_counts(held["width"], held["bits"]), SENT).union(known))
    sums = spark.read.parquet(f"{path}/sums").withColumns({"kind": F.col("kind").cast("int"), "turn": F.lit(0), "batch": F.lit(MODEL).cast("long")})
    scored = scored_batches(parts, totals, model, held["width"], held["bits"])
    return texts_of(scored.unionByName(sums, allowMissingColumns=True), held["n"])


def op9_katz_backoff(spark, sf_dir: str) -> DataFrame:
    """All documents; learns from those whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_remainder(F.col("doc_id"), 7) != 2).alias("train"))
    scored = score_texts(docs)
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
