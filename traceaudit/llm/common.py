"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.session import scratch_dir

#: Narrow rows that a broadcast table has at most.
SMALL_ROWS = 1_000_000
#: may_be_in has 2 ** KEY_BITS bits.
KEY_BITS = 24
#: Distinct words whose hashes a Python worker remembers at once.
MEMO_WORDS = 200_000
#: Words of more bytes are hashed one by one.
LONG_WORD = 32


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again, so that a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most `most` of them; else Spark chooses by its size and shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def may_be_in(df: DataFrame, key: str, ids: DataFrame, others: bool = False) -> DataFrame:
    """The rows of df whose key stands in ids(key), and a few more: a bit for each hash value of the ids, looked up before any shuffle of df. With `others`, all other rows of df instead.

    The bits are a broadcast table of 2 ** KEY_BITS / 64 short rows at most, however many ids there are; with very many ids more rows pass, so
    an exact join has to follow.
    """
    at, word = new_names(df, "at", "word")
    bit = lambda: F.xxhash64(key).bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    place = lambda: F.shiftright(bit(), 6).cast("int")
    inside = lambda: (bit() % 64).cast("int")
    table = ids.groupBy(place().alias(at)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), inside())).alias(word))
    found = df.join(F.broadcast(table), place() == F.col(at), "left")
    hit = F.coalesce(F.call_function("shiftright", F.col(word), inside()).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    return found.filter(~hit if others else hit).select(*df.columns)


def new_names(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores in front as it takes to be no column of df (upper and lower case count as the same)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def require_new(df: DataFrame, column: str) -> None:
    if column.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has a column {column!r}; name another one for the result")


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text, with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word; forgets all when MEMO_WORDS are known."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 arrays, so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word (none of them null or empty) of an Arrow array, eight bytes of all words at a time."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.empty(0, np.uint64)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.concatenate([np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    first = np.append(np.uint64(0), ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * np.arange(1, 9, dtype=np.uint64)))  # masks of so many bytes
    begin, size = at[:-1] - at[0], np.diff(at)
    h = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (eight[begin] & first[np.minimum(size, 8)]))
    for done in range(8, LONG_WORD, 8):
        more = np.flatnonzero(size > done)
        h[more] = mix64(h[more] + (eight[begin[more] + done] & first[np.minimum(size[more] - done, 8)]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : begin[i] + size[i]])
    return h


def hashed_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (see words_of) of an Arrow array of texts, one text after the other, and the place of each text's first one, followed by their number."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    real = pc.not_equal(pc.binary_length(words), 0)  # white space at an end leaves an empty word
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    places = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    return hashes_of(words.filter(real)), before[places]


def shingle_hashes(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each k consecutive words, in text order; a shorter, non-empty text is one shingle of all its words."""
    n = len(h)
    width = min(n, k)
    if not n:
        return np.empty(0, np.uint64)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : n - width + 1 + j]
    return mix64(out)


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes first, which compress well where high bytes are zero."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def slices_of(keys: np.ndarray, bits: int):
    """(slice, from, to) of the ranges of sorted hashes that occur; a range is the upper `bits` bits."""
    top = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(top, prepend=-1))
    return zip(top[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)][: len(starts)], strict=True)


def pieces_of(batches, rows: int):
    """The same record batches in pieces of at most `rows` rows, for less memory once they become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sorted_runs(batches, keys: tuple[str, ...]):
    """Lists of rows (dicts) with equal keys, from batches sorted by them."""
    held, key = [], None
    for batch in pieces_of(batches, 64):
        for row in batch.to_pylist():
            now = tuple(row[k] for k in keys)
            if now != key and held:
                yield held
                held = []
            key = now
            held.append(row)
    if held:
        yield held


def in_runs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*order)
