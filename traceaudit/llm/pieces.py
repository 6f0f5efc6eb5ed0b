"""SentencePiece encoding and decoding with one forward pass over a trie of distinct words.

A text becomes marked words: the space mark U+2581 stands before it and for each space, and no piece crosses from a
character into a mark, so marked words are encoded apart from each other. The distinct new words of a batch are sorted, which is a
depth-first walk of their trie; the forward table has one entry per prefix, and going on to the next word only cuts
the table back to the common prefix and extends it from there. A forward entry is the best last piece of its prefix:

* unigram: the piece with which the sum of scores is largest (Viterbi), kept with that sum;
* bpe: merges in score order, rather than sums, define the result. The encoding of a prefix is the encoding of a shorter
  prefix plus one last piece, namely the only one that merges leave standing beside the piece before it, so the same
  forward table gives the library's ids exactly.

Any vocabulary file can be read as either kind. As bpe, the ids equal the library's; as unigram, no segmentation that the library's n-best search
finds scores higher.

Characters without a piece become their UTF-8 bytes. Encoding and decoding read each text once and shuffle nothing.
"""

from __future__ import annotations

import re
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceaudit.llm.common import require_new
from traceaudit.session import table

MARK = "▁"
#: Path of the vocabulary file; a parameter of load().
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text whose distinct words are walked together, and words whose ids a worker remembers.
BATCH_CHARS = 2_000_000
MEMO_WORDS = 200_000
#: Pairs of pieces and automaton edges that a worker remembers.
MEMO_PAIRS = 400_000
MEMO_EDGES = 200_000
UNKNOWN = -1
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def load(path: str = MODEL, *kinds: str) -> dict:
    """The pieces of a SentencePiece model file as plain data: pieces, scores, byte_ids. Control, unknown and byte pieces never match text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
    pieces = [model.id_to_piece(i) for i in range(n)]
    byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
    crossing = [p for p, ok in zip(pieces, plain, strict=True) if ok and MARK in p.lstrip(MARK)]
    if crossing or not set(kinds) <= {"bpe", "unigram"}:
        raise ValueError(f"kinds {kinds}, pieces with an inner space mark: {crossing[:3]}")
    silent = [i for i in range(n) if model.is_control(i)]
    return {"pieces": pieces, "scores": [model.get_score(i) for i in range(n)], "plain": plain, "byte_ids": byte_ids, "unk": model.unk_id(), "silent": silent}


class Encoder:
    """Forward tables over sorted words."""

    def __init__(self, model: dict):
        self.pieces, self.scores, self.kind = model["pieces"], model["scores"], model["kind"]
        self.ids = {p: i for i, (p, ok) in enumerate(zip(self.pieces, model["plain"], strict=True)) if ok}
        self.lengths = list(map(len, self.pieces))
        self.byte_ids, self.unk = model["byte_ids"], model["unk"]
        self.unknown_score = min(self.scores, default=0.0) - 10.0
        self.beside: dict[int, bool] = {}  # of pairs of pieces, by first * number of pieces + second
        self.halves: dict[int, tuple[int, int]] = {}
        self.made_at = [-1.0 if len(p) == 1 else -x for p, x in zip(self.pieces, self.scores, strict=True)]  # merges in order of falling score
        self.memo: dict[str, tuple[int, ...]] = {}
        self.automaton()

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Pieces of a short text by merging neighbours in order of score, leftmost first, until no merge is left or `least` pieces are."""
        parts = list(text)
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def last_merge(self, piece: int) -> tuple[int, int] | None:
        """The two pieces that merge last into this one; itself twice for a single character, None for a piece that merges never make."""
        parts = self.merged(self.pieces[piece], 2)
        if len(parts) == 1:
            return piece, piece
        if len(parts) > 2 or self.merged(self.pieces[piece]) != [self.pieces[piece]]:
            return None
        return self.ids[parts[0]], self.ids[parts[1]]

    def stand_together(self, a: int, b: int) -> bool:
        """Whether merges leave a and b standing side by side: going back through the merges that made them, later ones first, no
        merge across their border may come before the merge that takes its left or right part away. Remembered, up to MEMO_PAIRS."""
        x, y, limit, ok = a, b, float("inf"), True
        while True:
            across = self.ids.get(self.pieces[x] + self.pieces[y])
            if across is not None and self.made_at[across] < limit:
                ok = False
                break
            if self.made_at[x] < 0 and self.made_at[y] < 0:
                break
            if self.made_at[x] > self.made_at[y]:
                limit, x = self.made_at[x], self.halves[x][1]
            else:  # of two merges of one score the left one comes first
                limit, y = self.made_at[y] + 0.5, self.halves[y][0]
        if len(self.beside) >= MEMO_PAIRS:
            self.beside.clear()
        self.beside[a * len(self.pieces) + b] = ok
        return ok

    def automaton(self) -> None:
        """All pieces that may end at a place, longest first, for each state of a suffix automaton over the pieces; unreachable pieces are left out."""
        self.next, self.ends, self.fail, self.learnt = [{}], [()], [0], 0
        for piece, i in self.ids.items():
            if self.kind == "bpe":
                halves = self.last_merge(i)
                if halves is None:
                    continue
                self.halves[i] = halves
            state = 0
            for ch in piece:
                if ch not in self.next[state]:
                    self.next[state][ch] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                    self.fail.append(0)
                state = self.next[state][ch]
            self.ends[state] = ((i, len(piece)),)
        todo = list(self.next[0].values())
        for state in todo:
            for ch, child in self.next[state].items():
                f = self.fail[state]
                while f and ch not in self.next[f]:
                    f = self.fail[f]
                self.fail[child] = self.next[f].get(ch, 0)
                todo.append(child)
            self.ends[state] += self.ends[self.fail[state]]

    def step(self, state: int, ch: str) -> int:
        """The state after ch where the state has no edge for it; remembered up to MEMO_EDGES."""
        f = state
        while f and ch not in self.next[f]:
            f = self.fail[f]
        target = self.next[f].get(ch, 0)
        if self.learnt < MEMO_EDGES:
            self.learnt += 1
            self.next[state][ch] = target
        return target

    def extend_unigram(self, i: int, state: int, best: list[float]) -> int:
        """The last piece of the best segmentation of the first i characters; appends its score to best."""
        top, pick = (best[i - 2] if i > 1 else 0.0) + self.unknown_score, UNKNOWN
        for piece, length in self.ends[state]:
            value = (best[i - length - 1] if length < i else 0.0) + self.scores[piece]
            if value > top:
                top, pick = value, piece
        best.append(top)
        return pick

    def encode_sorted(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each of the sorted, distinct marked words: a depth-first walk that keeps the forward entries of the common prefix."""
        out: dict[str, tuple[int, ...]] = {}
        last: list[int] = []
        states = [0]
        best: list[float] = []
        follow, ends, beside, n_pieces, bpe = self.next, self.ends, self.beside, len(self.pieces), self.kind == "bpe"
        lengths = self.lengths
        previous = ""
        for word in words:
            n, depth = min(len(previous), len(word)), 0
            if previous[: n >> 1] == word[: n >> 1]:
                depth = n >> 1
            while depth < n and previous[depth] == word[depth]:
                depth += 1
            del last[depth:], states[depth + 1 :], best[depth:]
            state = states[-1]
            for i in range(depth, len(word)):
                ch = word[i]
                target = follow[state].get(ch)
                state = self.step(state, ch) if target is None else target
                states.append(state)
                if bpe:
                    for piece, length in ends[state]:
                        if length > i:
                            break
                        before = last[i - length]
                        if before == UNKNOWN:
                            break
                        ok = beside.get(before * n_pieces + piece)
                        if ok or ok is None and self.stand_together(before, piece):
                            break
                    else:
                        piece = UNKNOWN
                else:
                    piece = self.extend_unigram(i + 1, state, best)
                last.append(piece)
            found: list[int] = []
            i = len(word)
            while i:
                piece = last[i - 1]
                if piece == UNKNOWN:
                    found += [self.byte_ids.get(b, self.unk) for b in reversed(word[i - 1].encode("utf-8", "surrogatepass"))] if self.byte_ids else [self.unk]
                    i -= 1
                else:
                    found.append(piece)
                    i -= lengths[piece]
            found.reverse()
            out[word] = tuple(found)
            previous = word
        return out

    def encode(self, words: list[str], at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many each text has) from words_in(texts)."""
        memo = self.memo
        new = [w for w in words if w not in memo]
        if len(memo) + len(new) > MEMO_WORDS:  # words that are in use just now are likely to come again
            memo = self.memo = {w: memo[w] for w in words if w in memo}
        new.sort()
        memo.update(self.encode_sorted(new))
        found = list(map(memo.__getitem__, words))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        mine = lengths[at]
        text = np.repeat(np.arange(len(sizes)), sizes)
        return flat[ranges(starts[at], mine)], np.bincount(text, mine, minlength=len(sizes)).astype(np.int64)

class Decoder:
    """Ids back to text."""

    def __init__(self, model: dict):
        silent = set(model["silent"])
        by_id = {i: bytes([b]) for b, i in model["byte_ids"].items()}
        found = [by_id.get(i, b"" if i in silent else " ⁇ ".encode() if i == model["unk"] else p.replace(MARK, " ").encode()) for i, p in enumerate(model["pieces"])]
        self.byte_lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.byte_data = np.frombuffer(b"".join(found), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> pa.Array:
        """The texts of ids[offsets[i] : offsets[i + 1]], null where null is."""
        lengths = self.byte_lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        data = self.byte_data[ranges(self.byte_starts[ids], lengths)]
        first = np.zeros(len(null), bool)
        some = ends[1:] > ends[:-1]
        first[some] = data[ends[:-1][some]] == 32
        keep = np.ones(len(data), bool)
        keep[ends[:-1][first]] = False  # one space in front is the mark of the first word
        ends = ends - np.concatenate([[0], np.cumsum(first)])
        data = data[keep].tobytes()
        try:
            data.decode()  # where all of it is UTF-8 and no text begins within a character, each text is
            heads = np.frombuffer(data, np.uint8)[ends[:-1][ends[1:] > ends[:-1]]]
            if ((heads & 0xC0) != 0x80).all():
                return pa.StringArray.from_buffers(len(null), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data), pa.array(~null).buffers()[1])
        except UnicodeDecodeError:
            pass
        return pa.array([None if null[i] else data[ends[i] : ends[i + 1]].decode("utf-8", "replace") for i in range(len(null))], pa.string())


class WordNumbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def words_in(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct marked words, the number of each word of the texts in order, how many words each text has). A null text has none."""
    numbers = WordNumbers()
    chunks = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    at = np.fromiter(map(numbers.__getitem__, chain.from_iterable(chunks)), np.int64, int(sizes.sum()))
    return list(numbers), at, sizes


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(shift, lengths)


def encoder_of(shared, key: str, kind: str) -> Encoder:
    """The encoder of a broadcast model. A worker process that runs many tasks keeps those of one vocabulary, with the words and pairs they know."""
    kept = sys.modules.setdefault("_piece_encoders", types.ModuleType("_piece_encoders")).__dict__
    if kept.get("key") != key:
        kept.clear()
        kept["key"] = key
    if kind not in kept:
        kept[kind] = Encoder({**shared.value, "kind": kind})
    return kept[kind]


def slices(texts: list[str | None], chars: int = BATCH_CHARS):
    """(from, to) of consecutive texts with about `chars` characters each; a longer text is a slice of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > chars:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def spans(lists, ids: int = BATCH_CHARS // 4):
    """(from, to) of consecutive lists with about `ids` ids each; a longer list is a span of its own."""
    offsets = lists.offsets.to_numpy()
    start = 0
    for i in range(1, len(lists) + 1):
        if i == len(lists) or offsets[i + 1] - offsets[start] > ids:
            yield start, i
            start = i


def encode_as(docs: DataFrame, columns: dict[str, str], path: str = MODEL) -> DataFrame:
    """docs with one more array<int> column for each of columns, a dict of names and kinds (bpe or unigram); other columns stay. See encode."""
    for column in columns:
        require_new(docs, column)
    shared, key = docs.sparkSession.sparkContext.broadcast(load(path, *columns.values())), path

    def run(batches):
        encoders = [encoder_of(shared, key, kind) for kind in columns.values()]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                part, words = batch.slice(a, b - a), words_in(texts[a:b])
                null = pa.array([t is None for t in texts[a:b]])
                for column, encoder in zip(columns, encoders, strict=True):
                    ids, sizes = encoder.encode(*words)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    part = part.append_column(column, pa.ListArray.from_arrays(offsets, pa.array(ids), mask=null))
                yield part

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in columns]]))


def encode(docs: DataFrame, path: str = MODEL, kind: str = "bpe", column: str = "ids") -> DataFrame:
    """docs with one more column, the ids of text as array<int>; other columns stay.

    A null text has null ids and an empty one none. Very long texts are encoded whole. A column of that name must not exist.
    """
    return encode_as(docs, {column: kind}, path)


def decode(rows: DataFrame, path: str = MODEL, column: str = "decoded", ids: str = "ids") -> DataFrame:
    """rows with one more column, the text of the ids; null where ids are null. Bytes that are not UTF-8 become U+FFFD; an id outside the vocabulary is an error, as is a column that has the name already."""
    require_new(rows, column)
    shared, key = rows.sparkSession.sparkContext.broadcast(load(path)), path

    def run(batches):
        encoder = Decoder(shared.value)
        for batch in batches:
            for a, b in spans(batch.column(ids)):
                lists = batch.column(ids).slice(a, b - a)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                values = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
                texts = encoder.decode(values, offsets - offsets[0], lists.is_null().to_numpy(zero_copy_only=False))
                yield batch.slice(a, b - a).append_column(column, texts)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(column, T.StringType())]))


def round_trip(spark, sf_dir: str, kind: str) -> DataFrame:
    """doc_id, n_pieces, ids_hash (Spark's xxhash64 of the id array), round_trip (decoding gives the text, with a literal space mark read as a space) of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode(encode(docs, kind=kind))
    same = F.col("decoded").eqNullSafe(F.replace("text", F.lit(MARK), F.lit(" ")))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents by Viterbi over the vocabulary's pieces and scores. See round_trip."""
    return round_trip(spark, sf_dir, "unigram")


def sentencepiece_merges(spark, sf_dir: str) -> DataFrame:
    """All documents by the vocabulary's merges, the ids that its models were made with. See round_trip."""
    return round_trip(spark, sf_dir, "bpe")
