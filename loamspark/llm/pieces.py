"""SentencePiece encoding and decoding: batched numpy segmentation.

Texts are cut into words that no piece crosses; the distinct words of a batch are grouped by length, and all words
of one length advance together: polynomial hashes of their substrings probe the sorted hashes of the
pieces, and maxima are taken over whole columns.

* Unigram models: Viterbi. For every end, the best start is kept as a backpointer.
* BPE models (such as the public vocabulary here): the right segmentation is that of the merges and not a Viterbi
  path, so in each round every word takes its best-scored, leftmost merge, by the same probes and maxima.

Results equal those of the sentencepiece library, ids for ids. The pieces of all texts are spelled out and compared
with them; if a hash clash shows, they are segmented by plain strings.

Defined cases: null gives null; the empty text has no ids; a literal U+2581 reads back as a space, as in the
library; characters without a piece become bytes, or <unk>; ids outside the vocabulary decode to
nothing; bytes that are no UTF-8 decode to U+FFFD each.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shielded, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Brings the differences of short pieces into the leading bits.
SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Words beyond this length are segmented one by one with a heap, in n log n.
LONG = 48
#: Characters taken at once; a longer text is cut where a word begins, which no piece crosses.
PIECE = 250_000
NORMAL, UNKNOWN, BYTE = 1, 2, 6

codecs.register_error("each-byte", lambda e: ("\ufffd", e.start + 1))


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Of a protocol buffer message: field numbers and values."""

    def number(at: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            b = raw[at]
            x, at, shift = x | (b & 127) << shift, at + 1, shift + 7
            if b < 128:
                return x, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else (8 if key & 7 == 1 else 4, at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class Pieces:
    def __init__(self, raw: bytes) -> None:
        self.text, self.score, self.kind = [], [], []
        self.unigram, self.prefix, self.squeeze, charsmap = True, True, True, b""
        for k, v in _fields(raw):
            if k == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, x in _fields(v):
                    piece = x.decode() if f == 1 else piece
                    score = struct.unpack("<f", x)[0] if f == 2 else score
                    kind = x if f == 3 else kind
                self.text.append(piece)
                self.score.append(score)
                self.kind.append(kind)
            elif k == 2:
                self.unigram = dict(_fields(v)).get(3, 1) == 1
            elif k == 3:
                norm = dict(_fields(v))
                charsmap, self.prefix, self.squeeze = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if charsmap:
            raise ValueError("models that rewrite characters before segmentation are not supported")
        self._index()

    @classmethod
    def made(cls, pieces: list[tuple[str, float]], unigram: bool) -> Pieces:
        """A model of given pieces, with <unk> first and no bytes."""
        self = cls.__new__(cls)
        self.text, self.score = ["<unk>", *(p for p, _ in pieces)], [0.0, *(s for _, s in pieces)]
        self.kind, self.unigram, self.prefix, self.squeeze = [UNKNOWN, *[NORMAL] * len(pieces)], unigram, True, False
        self._index()
        return self

    def _index(self) -> None:
        self.id = {p.replace(MARK, " "): i for i, (p, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == NORMAL}
        self.unk = self.kind.index(UNKNOWN) if UNKNOWN in self.kind else 0
        self.byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        spelled = list(self.id)
        if any(" " in p.lstrip(" ") for p in spelled):
            raise ValueError("pieces that cross words are not supported")
        self.lines = not any("\n" in p and len(p) > 1 for p in spelled)
        self.most = max(map(len, spelled), default=1)
        h = np.array([self._hash(p) for p in spelled], np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.hash_id = h[order], np.array([self.id[p] for p in spelled], np.int32)[order]
        self.hash_size = np.array([len(p) for p in spelled], np.int64)[order]
        self.value = np.array(self.score, np.float64)
        self.low = min((self.score[i] for i in self.id.values()), default=0.0) - 10
        one = [bytes([b]) for b in range(256)]
        back = {i: b for b, i in self.byte.items()}
        self.spell = [one[back[i]] if i in back else p.replace(MARK, " ").encode() if k == NORMAL else " ⁇ ".encode() if k == UNKNOWN else b"" for i, (p, k) in enumerate(zip(self.text, self.kind, strict=True))]
        self.shift = np.uint64(64 - 17)
        bounds = np.searchsorted(self.hash, np.arange(1 << 17, dtype=np.uint64) << self.shift)
        self.lead = bounds.astype(np.int64)
        self.steps = int(np.diff(np.append(bounds, len(self.hash))).max())
        size = np.array([len(x) for x in self.spell], np.int64)
        self.table = size, np.cumsum(size) - size, np.frombuffer(b"".join(self.spell), np.uint8)
        self._powers = (np.ones(1, np.uint64),) * 2
        self.words = re.compile(r" +[^ \n]*|\n|[^ \n]+" if self.lines else r" +[^ ]*|[^ ]+")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_powers": (np.ones(1, np.uint64),) * 2}

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """BASE^k and BASE^-k, modulo 2^64, for k below n at least."""
        if len(self._powers[0]) < n:
            out = []
            for base in (int(BASE), pow(int(BASE), -1, 2**64)):
                x = np.ones(1, np.uint64)
                while len(x) < n:
                    x = np.concatenate((x, x * np.uint64(pow(base, len(x), 2**64))))
                out.append(x)
            self._powers = (out[0], out[1])
        return self._powers

    @staticmethod
    def _hash(piece: str) -> int:
        x = 0
        for c in piece:
            x = (x * int(BASE) + ord(c) + 1) % 2**64
        return x * int(SPREAD) % 2**64

    def _same_length(self, text: _Text, at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For words of one length that begin at `at`: which words, and the edges of their pieces, a row for each word."""
        return (self._viterbi if self.unigram else self._merges)(text, at, size)

    def _viterbi(self, text: _Text, at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, rows = len(at), np.arange(len(at))
        best, back = np.full((n, size + 1), -np.inf), np.zeros((n, size + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, size + 1):
            for start in range(max(0, end - self.most), end):
                i = text.probe(at + start, at + end)
                v = best[:, start] + np.where(i >= 0, self.value[i], self.low if end - start == 1 else -np.inf)
                back[:, end] = np.where(v > best[:, end], start, back[:, end])
                best[:, end] = np.maximum(best[:, end], v)
        now, path = np.full(n, size), [np.full(n, size)]
        while now.any():
            now = back[rows, now]
            path.append(now)
        edges = np.stack(path[::-1], axis=1)  # words of fewer pieces begin with zeros
        skip = (edges == 0).sum(axis=1) - 1
        for k in np.unique(skip):
            which = np.flatnonzero(skip == k)
            yield which, at[which, None] + edges[which, k:]

    def _merges(self, text: _Text, at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        word, rows = np.arange(len(at)), np.arange(len(at))
        edge = at[:, None] + np.arange(size + 1)
        i = text.probe(edge[:, :-2], edge[:, 2:]) if size > 1 else np.zeros((len(at), 0), np.int64)
        score = np.where(i >= 0, self.value[i], -np.inf)
        while len(word):
            if not score.shape[1]:
                yield word, edge
                return
            best = score.argmax(axis=1)
            over = score[rows, best] == -np.inf
            if over.any():
                yield word[over], edge[over]
                word, edge, score, best = word[~over], edge[~over], score[~over], best[~over]
                rows = np.arange(len(word))
                if not len(word):
                    return
            keep = np.ones(edge.shape, bool)
            keep[rows, best + 1] = False
            edge = edge[keep].reshape(len(word), -1)
            keep = np.ones(score.shape, bool)
            keep[rows, best] = False
            score = score[keep].reshape(len(word), -1)
            for k in (best - 1, best):
                r = np.flatnonzero((k >= 0) & (k < score.shape[1]))
                i = text.probe(edge[r, k[r]], edge[r, k[r] + 2])
                score[r, k[r]] = np.where(i >= 0, self.value[i], -np.inf)

    def _alone(self, word: str) -> list[int]:
        """Ends of the pieces of one word, by plain strings: for long words and hash clashes."""
        n = len(word)
        if self.unigram:
            best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
            for end in range(1, n + 1):
                for start in range(max(0, end - self.most), end):
                    i = self.id.get(word[start:end])
                    v = best[start] + (self.score[i] if i is not None else self.low if end - start == 1 else -np.inf)
                    if v > best[end]:
                        best[end], back[end] = v, start
            ends, at = [], n
            while at:
                ends.append(at)
                at = back[at]
            return ends[::-1]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def push(a: int) -> None:
            b = after[a]
            if b < n and after[b] - a <= self.most and (i := self.id.get(word[a : after[b]])) is not None:
                heapq.heappush(heap, (-self.score[i], a, b, after[b]))

        for a in range(n):
            push(a)
        while heap:
            _, a, b, end = heapq.heappop(heap)
            if alive[a] and b < n and alive[b] and after[a] == b and after[b] == end:
                after[a], alive[b] = end, False
                if end < n:
                    before[end] = a
                push(a)
                if before[a] >= 0:
                    push(before[a])
        ends, at = [], 0
        while at < n:
            at = after[at]
            ends.append(at)
        return ends

    def _ids(self, word: str, ends: list[int]) -> list[int] | None:
        out, a = [], 0
        for b in ends:
            if (i := self.id.get(word[a:b])) is not None:
                out.append(i)
            elif b - a > 1:
                return None
            elif self.byte:
                out += [self.byte[x] for x in word[a:b].encode()]
            elif not (out and out[-1] == self.unk):
                out.append(self.unk)
            a = b
        return out

    def slow(self, text: str) -> list[int]:
        """The ids of a normalised text, word by word with plain strings."""
        out: list[int] = []
        for w in self.words.findall(text):
            a = 0
            for b in self._alone(w):
                if (i := self.id.get(w[a:b])) is not None:
                    out.append(i)
                elif self.byte:
                    out += [self.byte[x] for x in w[a:b].encode()]
                elif not (out and out[-1] == self.unk):
                    out.append(self.unk)
                a = b
        return out

    def _normal(self, text: str) -> str:
        text = text.replace(MARK, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return " " + text if text and self.prefix else text

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Lists of ids. The pieces of a text must spell it; else, on a hash clash, it is taken word by word."""
        tokens, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        part: list[str] = []
        owner: list[int] = []
        took = 0

        def flush() -> None:
            ids, n = self._chunk(part)
            if not self._spells(ids, "".join(part).encode()):
                each = [self.slow(t) for t in part]
                ids, n = np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)
            tokens.append(ids)
            np.add.at(counts, owner, n)

        for k, t in enumerate(texts):
            if not self.byte:
                ids = self._words(self._normal(t or ""))
                tokens.append(np.array(ids, np.int32))
                counts[k] = len(ids)
                continue
            for stretch in self._stretches(self._normal(t or "")):
                if part and took + len(stretch) > PIECE:
                    flush()
                    part, owner, took = [], [], 0
                part.append(stretch)
                owner.append(k)
                took += len(stretch)
        if part:
            flush()
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        missing = np.array([t is None for t in texts], bool)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens)), mask=pa.array(missing) if missing.any() else None)

    @staticmethod
    def _stretches(text: str) -> Iterator[str]:
        """A normalised text in stretches of about PIECE characters that begin with a word."""
        at = 0
        while len(text) - at > PIECE:
            cut = text.find(" ", at + PIECE)
            if cut < 0:
                break
            while text[cut - 1] == " " and cut > at + 1:
                cut -= 1
            if text[cut - 1] == " ":
                break
            yield text[at:cut]
            at = cut
        if at < len(text):
            yield text[at:]

    def _words(self, text: str) -> list[int]:
        """As slow(), with the batched segmentation: for models without bytes, in which unknown neighbours become one."""
        if not text:
            return []
        ids, _ = self._chunk([text])
        out: list[int] = []
        for i in ids.tolist():
            if not (i == self.unk and out and out[-1] == self.unk):
                out.append(i)
        return out

    def _spells(self, ids: np.ndarray, raw: bytes) -> bool:
        size, start, flat = self.table
        n = size[ids]
        return int(n.sum()) == len(raw) and flat[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(len(raw))].tobytes() == raw

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of normalised texts, one after the other, and how many each has."""
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        if not length.sum():
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        text = _Text(self, "".join(texts))
        c, begin = text.code, np.cumsum(length) - length
        new = c == 32
        new[1:] &= c[:-1] != 32
        if self.lines:
            line = c == 10
            new |= line
            new[1:] |= line[:-1]
        new[begin[length > 0]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(c))
        _, first, word = np.unique(text.hash(start, end) ^ ((end - start).astype(np.uint64) << np.uint64(40)), return_index=True, return_inverse=True)
        at, size = start[first], end[first] - start[first]
        order, counts, flat = [], [], []
        for n in np.unique(size):
            which = np.flatnonzero(size == n)
            if n > LONG:
                found = ((np.array([i]), (at[i] + np.array([0, *self._alone("".join(map(chr, c[at[i] : at[i] + n].tolist())))]))[None]) for i in which)
            else:
                found = ((which[k : k + 50_000][w], e) for k in range(0, len(which), 50_000) for w, e in self._same_length(text, at[which[k : k + 50_000]], int(n)))
            for w, edge in found:
                ids = text.probe(edge[:, :-1], edge[:, 1:]).reshape(-1)
                per = np.full(len(w), edge.shape[1] - 1)
                if (ids < 0).any():
                    ids, per = self._unknown(ids, c[edge[:, :-1].reshape(-1)], len(w))
                order.append(w)
                counts.append(per)
                flat.append(ids)
        n = np.zeros(len(at), np.int64)
        begins = np.zeros(len(at), np.int64)
        order_, counts_ = np.concatenate(order), np.concatenate(counts)
        n[order_], begins[order_] = counts_, np.cumsum(counts_) - counts_
        m = n[word]
        ids = np.concatenate(flat).astype(np.int32)[np.repeat(begins[word] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        sums = np.concatenate(([0], np.cumsum(m)))
        edges = np.searchsorted(start, np.append(begin, len(c)))
        return ids, sums[edges[1:]] - sums[edges[:-1]]

    def _unknown(self, ids: np.ndarray, code: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become bytes, or <unk>: the new ids, and how many each word has."""
        n, bad = np.ones(len(ids), np.int64), np.flatnonzero(ids < 0)
        if not self.byte:
            ids = ids.copy()
            ids[bad] = self.unk
            return ids, n.reshape(words, -1).sum(axis=1)
        spelled = {x: [self.byte[b] for b in chr(x).encode("utf-8", "replace")] for x in set(code[bad].tolist())}
        each = [spelled[x] for x in code[bad].tolist()]
        n[bad] = [len(x) for x in each]
        out = np.repeat(ids, n)
        out[np.repeat(ids < 0, n)] = [b for x in each for b in x]
        return out, n.reshape(words, -1).sum(axis=1)

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """Texts of lists of ids, of int32."""
        size = np.array([len(x) for x in self.spell] + [0], np.int64)
        flat = np.frombuffer(b"".join(self.spell), np.uint8)
        start = np.cumsum(size) - size
        token = ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
        token = np.where((token < 0) | (token >= len(self.spell)), len(self.spell), token)
        edge = ids.offsets.to_numpy()
        out: list[str | None] = []
        for d, valid in enumerate(ids.is_valid().to_pylist()):
            if not valid:
                out.append(None)
                continue
            t = token[edge[d] : edge[d + 1]]
            n = size[t]
            raw = flat[np.repeat(start[t] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()
            if self.prefix and len(t) and t[0] < len(self.spell) and self.kind[t[0]] == NORMAL and raw[:1] == b" ":
                raw = raw[1:]
            out.append(raw.decode("utf-8", "each-byte"))
        return pa.array(out, pa.string())


class _Text:
    """A text with hashes of all its substrings: sums of (code + 1) * BASE^-place, made comparable by a power."""

    def __init__(self, pieces: Pieces, text: str) -> None:
        self.p = pieces
        self.code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        up, down = pieces.powers(len(self.code))
        self.sum = np.zeros(len(self.code) + 1, np.uint64)
        np.cumsum((self.code.astype(np.uint64) + np.uint64(1)) * down[: len(self.code)], out=self.sum[1:])
        self.up = up

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sum[b] - self.sum[a]) * self.up[b - 1] * SPREAD

    def probe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of the pieces that the substrings from a to b are, else -1."""
        p, h = self.p, self.hash(a, b)
        # a table over the leading bits narrows the binary search to a few steps
        at = p.lead[(h >> p.shift).astype(np.int64)]
        for _ in range(p.steps):
            at = at + (p.hash[np.minimum(at, len(p.hash) - 1)] < h)
        at = np.minimum(at, len(p.hash) - 1)
        return np.where((p.hash[at] == h) & (p.hash_size[at] == b - a), p.hash_id[at], -1)


def read_model(path: str = MODEL) -> Pieces:
    """Read by the driver; workers get the bytes with the task."""
    return Pieces(Path(path).read_bytes())


def encode(text: Column, model: Pieces) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield model.encode(texts.to_pylist())

    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, model: Pieces) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield model.decode(x.cast(pa.list_(pa.int32())))

    return F.arrow_udf(run, "string")(ids.cast("array<int>"))


def round_trip(text: Column, model: Pieces) -> Column:
    """struct(ids, exact): whether decoding the ids gives the text back, U+2581 read as a space."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            whole = texts.to_pylist()
            ids = model.encode(whole)
            back = model.decode(ids).to_pylist()
            exact = [None if t is None else t.replace(MARK, " ") == b for t, b in zip(whole, back, strict=True)]
            yield pa.StructArray.from_arrays([ids, pa.array(exact, pa.bool_())], names=["ids", "exact"])

    return F.arrow_udf(run, "struct<ids:array<int>,exact:boolean>")(text)


@shielded
def tokenized(docs: DataFrame, text_col: str = "text", path: str = MODEL) -> DataFrame:
    """docs without its text, with ids, n_tokens and exact."""
    bounded_batches(docs.sparkSession)
    new = ("ids", "n_tokens", "exact", text_col)
    rows = docs.withColumn("__x", round_trip(F.col(text_col), read_model(path)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], F.col("__x.ids").alias("ids"), F.coalesce(F.size("__x.ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col("__x.exact").alias("exact"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents").select("doc_id", "text"))
