"""Counts of grams, bytes and word pairs: made for a batch of texts at once by numpy and Arrow, then summed by a group-by.

Only distinct (key, symbol) rows of a batch leave the Python worker, so what is shuffled is what a map-side combination leaves.
Batches are bounded by bytes, so a worker's memory does not grow with the texts. Null texts have nothing to count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
_FOLD = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile("[a-z'\\-\x80-\U0010ffff]+")


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, str(2**31 - 1))).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def codes(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the place of each among them."""
    return np.unique(values, return_inverse=True)


def ranked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """dense() of code points: by a table of them, without a sort, where that is not much longer than the text."""
    size = int(code.max()) + 1 if len(code) else 1
    if size > 1024 + 4 * len(code):
        return dense(code)
    seen = np.zeros(size, bool)
    seen[code] = True
    return np.flatnonzero(seen).astype(code.dtype), (np.cumsum(seen, dtype=np.int64) - 1)[code]


def groups_of(batch: pa.RecordBatch, n_keys: int) -> list[list[int]]:
    """Places of a batch's rows by the values of its first n_keys columns."""
    owners = zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True) if n_keys else [()] * batch.num_rows
    groups: dict[tuple, list[int]] = {}
    for i, owner in enumerate(owners):
        groups.setdefault(owner, []).append(i)
    return list(groups.values())


def gram_ids(symbols: np.ndarray, k: int, stride: int = 1) -> np.ndarray:
    """A number for each k code points, every stride-th, that begin at a place: equal for equal ones only."""
    n = len(symbols) - (k - 1) * stride
    if n <= 0:
        return np.zeros(0, np.int64)
    known, place = ranked(symbols)
    out, size = place[:n].astype(np.int64), max(2, len(known))
    room = size
    for j in range(1, k):
        if room > (1 << 62) // size:
            known_, out = dense(out)
            room = max(2, len(known_))
        out = out * size + place[j * stride : j * stride + n]
        room *= size
    return out


def _summed(df: DataFrame, keys: list[str], text_col: str, kind: str, names: list[str], count: Callable[[list[str]], list]) -> DataFrame:
    """keys, names, n: count() turns a batch's texts of one key into columns, the last one n."""
    bounded_batches(df.sparkSession)
    rows = df.select(*keys, F.col(text_col).alias("__text")).where("__text is not null")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            owners = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * len(texts)
            groups: dict[tuple, list[str]] = {}
            for owner, t in zip(owners, texts, strict=True):
                groups.setdefault(owner, []).append(t)
            for owner, group in groups.items():
                columns = count(group)
                if len(columns[-1]):
                    same = [pa.array([v], batch.schema.field(i).type).take(pa.array(np.zeros(len(columns[-1]), np.int32))) for i, v in enumerate(owner)]
                    yield pa.RecordBatch.from_arrays([*same, *columns], names=[*keys, *names, "n"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), kind, "n bigint"])
    return rows.mapInArrow(run, schema).groupBy(*keys, *names).agg(F.sum("n").alias("n"))


def gram_counts(df: DataFrame, keys: list[str], text_col: str, order: int, pad: str = "\x02") -> DataFrame:
    """keys, g, n: the order + 1 characters that end at each character; what stands before a text is pad."""

    def count(texts: list[str]) -> list:
        size = np.array([len(t) for t in texts], np.int64)
        code = codes("".join(pad * order + t for t in texts))
        begin = np.cumsum(size + order) - size - order
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        if not len(at):
            return [pa.array([], pa.string()), pa.array([], pa.int64())]
        _, first, n = np.unique(gram_ids(code, order + 1)[at], return_index=True, return_counts=True)
        flat = code[at[first][:, None] + np.arange(order + 1)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [pa.array([flat[i : i + order + 1] for i in range(0, len(flat), order + 1)], pa.string()), pa.array(n)]

    return _summed(df, keys, text_col, "g string", ["g"], count)


def _merged(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(ids)
    ids = ids[by]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1])))
    return ids[first], np.add.reduceat(n[by], first) if len(first) else n


class Ladder:
    """Counts of the order + 1 characters that end at each character, by owner, as numbers with some bits a character."""

    def __init__(self, order: int):
        self.order, self.bits = order, min(21, 63 // (order + 1))
        self.forget()

    def forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint32), np.full(128, -1, np.int64)
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def learn(self, code: np.ndarray) -> bool:
        """Whether all characters have numbers that fit, new ones too."""
        size = int(code.max()) + 1
        if size > len(self.place):
            self.place = np.concatenate((self.place, np.full(size - len(self.place), -1, np.int64)))
        new = np.unique(code[self.place[code] < 0])
        self.place[new] = len(self.known) + np.arange(len(new))
        self.known = np.concatenate((self.known, new))
        return len(self.known) <= 1 << self.bits

    def add(self, owner: int, code: np.ndarray, at: np.ndarray) -> None:
        """Of the places at which a gram begins."""
        place, n = self.place[code], len(code) - self.order
        ids = place[:n].copy()
        for j in range(1, self.order + 1):
            ids <<= self.bits
            ids |= place[j : j + n]
        found = np.unique(ids[at], return_counts=True)
        self.held.setdefault(owner, []).append(found)
        self.size += len(found[0])

    def merge(self) -> None:
        self.held = {k: [_merged(np.concatenate([x for x, _ in v]), np.concatenate([y for _, y in v]))] for k, v in self.held.items()}
        self.size = sum(len(v[0][0]) for v in self.held.values())

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """Grams of order + 1 characters as rows of code points."""
        return self.known[(ids[:, None] >> (np.arange(self.order, -1, -1) * self.bits)) & ((1 << self.bits) - 1)]

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """owner, grams, n: all that is held; then nothing is held any more."""
        self.merge()
        for owner, [(ids, n)] in self.held.items():
            yield owner, self.spelled(ids), n
        self.forget()


def byte_counts(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, b, n: bytes of the UTF-8 texts."""

    def count(texts: list[str]) -> list:
        n = np.bincount(np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        at = np.flatnonzero(n)
        return [pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))]

    return _summed(df, keys, text_col, "b int", ["b"], count)


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_FOLD))


#: What a byte of UTF-8 is in a word, 0 outside of words.
_LETTER = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c in b"'-" or c >= 128 else 0 for c in range(256)], np.uint8)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """words() of many texts at once: the number of each word, the different words, and the place of each word's text. Null texts have none."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    letter = _LETTER[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = np.zeros(len(letter) + 2, bool)
    inside[1:-1] = letter != 0
    new = np.zeros(len(letter) + 1, bool)  # at which a text begins
    new[at] = True
    first = np.flatnonzero(inside[1:] & (~inside[:-1] | new))
    last = np.flatnonzero(inside[:-1] & (~inside[1:] | new))
    ends = np.concatenate(([0], np.cumsum(last - first)))
    kind = pa.large_string() if wide else pa.string()
    found = pa.Array.from_buffers(kind, len(first), [None, pa.py_buffer(ends.astype(np.int64 if wide else np.int32)), pa.py_buffer(letter[letter != 0])]).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.cast(pa.string()), np.searchsorted(at, first, "right") - 1


def _counted(df: DataFrame, keys: list[str], text_col: str, kind: str, names: list[str], count: Callable[[pa.Array, np.ndarray], tuple[np.ndarray, list, np.ndarray]]) -> DataFrame:
    """keys, names, n: count() turns texts, and the number of each text's key, into the key's number, the columns and n of what it has counted."""
    bounded_batches(df.sparkSession)
    rows = df.select(*keys, F.col(text_col).alias("__text")).where("__text is not null")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = groups_of(batch, len(keys))
            owner = np.zeros(batch.num_rows, np.int64)
            for g, at in enumerate(groups):
                owner[at] = g
            g, columns, n = count(batch.column(len(keys)), owner)
            if len(n):
                at = pa.array(np.array([x[0] for x in groups])[g])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), *columns, pa.array(n.astype(np.int64))], names=[*keys, *names, "n"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), kind, "n bigint"])
    return rows.mapInArrow(run, schema).groupBy(*keys, *names).agg(F.sum("n").alias("n"))


def _views(known: pa.Array, views: list[tuple[int, int | None]]) -> tuple[np.ndarray, int, list[pa.Array]]:
    """The number of each word's views (slices of its characters), how many there are, and the views by their number."""
    number, size, parts = np.zeros(len(known), np.int64), 1, []
    for start, stop in views:
        part = known if (start, stop) == (0, None) else pc.utf8_slice_codeunits(known, start, stop)
        code = part.dictionary_encode()
        parts.append(part)
        number = number * len(code.dictionary) + code.indices.to_numpy(zero_copy_only=False)
        different, first, number = np.unique(number, return_index=True, return_inverse=True)
        size = len(different)
    return number, size, [p.take(pa.array(first)) for p in parts]


#: A word as it is.
WHOLE = [(0, None)]


def pair_counts(df: DataFrame, keys: list[str], text_col: str, a: dict[str, tuple[int, int | None]] | None = None, b: dict[str, tuple[int, int | None]] | None = None) -> DataFrame:
    """keys, a, b, n: neighbouring words of a text. a and b may name slices of the words (from, to) that are counted in their place."""
    a, b = a or {"a": WHOLE[0]}, b or {"b": WHOLE[0]}

    def count(texts: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        word, known, text = split_words(texts)
        if len(word) < 2:
            return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
        left, n_left, left_parts = _views(known, list(a.values()))
        right, n_right, right_parts = _views(known, list(b.values()))
        near = np.flatnonzero(text[1:] == text[:-1])
        pairs, n = np.unique((owner[text[near]] * n_left + left[word[near]]) * n_right + right[word[near + 1]], return_counts=True)
        g, first = np.divmod(pairs // n_right, n_left)
        return g, [*(p.take(pa.array(first)) for p in left_parts), *(p.take(pa.array(pairs % n_right)) for p in right_parts)], n

    return _counted(df, keys, text_col, ", ".join(f"`{k}` string" for k in (*a, *b)), [*a, *b], count)


def word_counts(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, word, n."""

    def count(texts: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        word, known, text = split_words(texts)
        found, n = np.unique(owner[text] * max(1, len(known)) + word, return_counts=True)
        return found // max(1, len(known)), [known.take(pa.array(found % max(1, len(known))))], n

    return _counted(df, keys, text_col, "word string", ["word"], count)
