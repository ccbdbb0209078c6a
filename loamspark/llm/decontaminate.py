"""Benchmark decontamination: training suffix arrays.

Each Arrow batch of documents is a shard. Its words become numbers, a suffix array over them is built by prefix doubling,
and every distinct window of the test items is binary-searched in it. A suffix whose first words include one that no test item has cannot match and
is left out before sorting, which loses nothing. Hits that follow each other are extended, both ways, to the
longest verbatim matches: one row for each maximal match, with its place in the document, its words, and the first item and
place that has it; item_ids has all items. So the output grows with hits and items and never with their product.

The benchmark is taken in blocks of at most BLOCK_BYTES. One block is one pass, without a shuffle; of several, each is a pass
of its own that leaves a row for each text with hits in the shared folder, and these meet the documents by a digest of the
text. A plan never has more than one Python node and the driver never holds more than one block.

Defined cases: null text has no words; an item of fewer than WINDOW words, but not none, is one window;
items without words or without item_id are no items; rows with one item_id are one item; a benchmark
without items hits nothing; an empty table gives an empty result; repeated rows each get their row.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, bounded_batches, forget, row_salt, run_id, shielded, stored, table

WINDOW, ITEMS = 8, 2
BLOCK_BYTES = 16 << 20
#: Shards end at the first document beyond so many words.
SHARD_WORDS = 500_000
FOUND = "struct<items:array<string>,matches:array<struct<doc_word:bigint,words:bigint,item:string,item_word:bigint>>>"
#: Single characters instead of ranges, and no going back: the JVM looks each up in one table (28.8 s with ranges, 1.7 s without on check_s, six cores).
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]++"

_KEPT = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    r"""A-Z lower-cased; words are runs of 0-9, a-z and what is not ASCII."""
    return (text or "").encode().translate(_KEPT).split()


def ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Numbers in the order of what follows each token, compared up to the next zero or depth tokens at least; 0 for zeros. Prefix doubling."""
    rank, k = tokens.astype(np.int64), 1
    zero = np.flatnonzero(tokens == 0)
    stop = np.append(zero, len(tokens))[np.searchsorted(zero, np.arange(len(tokens)))]
    free = stop - np.arange(len(tokens))  # tokens before the next zero
    while k < depth:
        ahead = np.zeros_like(rank)
        ahead[:-k] = rank[k:]
        _, rank = np.unique(rank * (rank.max(initial=0) + 1) + np.where(free >= k, ahead, 0), return_inverse=True)
        rank = np.where(tokens == 0, 0, rank + 1)
        k *= 2
    return rank


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of non-zero tokens by what follows."""
    order = np.argsort(ranks(tokens, depth), kind="stable")
    return order[np.count_nonzero(tokens == 0) :]


class TestIndex:
    """The items of a block as numbers of its own vocabulary, a zero after each, and their distinct windows with the places of each."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        known, self.window = self.vocabulary, window
        lists: dict[str, list[list[int]]] = {}
        for name, text in items:
            if w := [known.setdefault(x, len(known) + 1) for x in words(text)]:
                lists.setdefault(name, []).append(w)
        self.names = sorted(lists)
        texts = [(k, w) for k, name in enumerate(self.names) for w in lists[name]]
        size = np.array([len(w) for _, w in texts], np.int64)
        self.begin = np.cumsum(size + 1) - size - 1
        self.owner = np.array([k for k, _ in texts], np.int64)
        self.flat = np.zeros(int((size + 1).sum()), np.int32)
        for b, (_, w) in zip(self.begin.tolist(), texts, strict=True):
            self.flat[b : b + len(w)] = w
        n = np.maximum(1, size - window + 1)
        start = np.repeat(self.begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        _, first, kind = np.unique(ranks(self.flat, window)[start], return_index=True, return_inverse=True)
        self.start, self.length = start[first], np.repeat(np.minimum(size, window), n)[first]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(kind, minlength=len(first))))).astype(np.int64)
        self.place = start[np.argsort(kind, kind="stable")]
        #: The window that begins at each place, if it is a whole one.
        self.full = np.full(len(self.flat) + 1, -1, np.int64)
        whole = self.length[kind] == window
        self.full[start[whole]] = kind[whole]
        self.least = int(self.length.min()) if len(first) else 0

    def where(self, place: int) -> tuple[str, int]:
        """The item of a place, and its word there."""
        k = int(np.searchsorted(self.begin, place, side="right")) - 1
        return self.names[self.owner[k]], place - int(self.begin[k])

    def places(self, kind: int) -> np.ndarray:
        return self.place[self.first[kind] : self.first[kind + 1]]

    def items(self, kinds: np.ndarray) -> list[str]:
        """The names of all items that have one of these distinct windows."""
        at = np.concatenate([self.places(k) for k in kinds.tolist()])
        return [self.names[k] for k in np.unique(self.owner[np.searchsorted(self.begin, at, side="right") - 1]).tolist()]


def search(tokens: np.ndarray, order: np.ndarray, test: TestIndex) -> tuple[np.ndarray, np.ndarray]:
    """For each test window the range of the suffix array that begins with it: all windows are searched side by side."""
    padded = np.concatenate((tokens, np.zeros(test.window, tokens.dtype)))
    ends = []
    for upper in (False, True):
        lo, hi = np.zeros(len(test.length), np.int64), np.full(len(test.length), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            sign = np.zeros(len(lo), np.int64)
            for d in range(test.window):
                differ = (sign == 0) & (d < test.length)
                wanted = test.flat[np.minimum(test.start + d, len(test.flat) - 1)]
                sign = np.where(differ, np.sign(padded[at + d].astype(np.int64) - wanted), sign)
            right = sign <= 0 if upper else sign < 0
            lo = np.where(open_ & right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        ends.append(lo)
    return ends[0], ends[1]


def hits(tokens: np.ndarray, test: TestIndex) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every occurrence of a test window, by position; zeros in tokens separate what cannot match."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not test.names or not len(tokens):
        return none
    # runs of test words that are too short for any window go
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (tokens != 0).astype(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= test.least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none
    size = ends - starts
    new = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    place = np.repeat(starts - new, size + 1) + np.arange(int((size + 1).sum()))
    small = tokens[np.minimum(place, len(tokens) - 1)]
    small[new + size] = 0
    order = suffix_array(small, test.window)
    lo, hi = search(small, order, test)
    hit = np.flatnonzero(hi > lo)
    n = hi[hit] - lo[hit]
    at = place[order[np.repeat(lo[hit], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]]
    by = np.argsort(at, kind="stable")
    return at[by], np.repeat(hit, n)[by]


def longest(at: np.ndarray, kind: np.ndarray, test: TestIndex) -> list[tuple[int, int, int]]:
    """(position, words, place in the test) of maximal verbatim matches that cover the hits of a document, by position."""
    whole = test.length[kind] == test.window
    a, k = at[whole], kind[whole]
    out: list[tuple[int, int, int]] = []
    edges = np.flatnonzero(np.diff(a) != 1) + 1
    for lo, end in zip([0, *edges.tolist()], [*edges.tolist(), len(a)], strict=True):
        i = lo
        while i < end:
            left, found = i, test.places(k[i])
            while left > lo and len(before := found[test.full[found - 1] == k[left - 1]]):
                left, found = left - 1, before - 1
            right = i
            while right + 1 < end and len(after := found[test.full[found + right + 1 - left] == k[right + 1]]):
                right, found = right + 1, after
            out.append((int(a[left]), right - left + test.window, int(found[0])))
            i = right + 1
    covered = -1
    begins = np.array([m[0] for m in out], np.int64)
    reach = np.maximum.accumulate(np.array([m[0] + m[1] for m in out], np.int64)) if out else begins
    for p, c in zip(at[~whole].tolist(), kind[~whole].tolist(), strict=True):
        n, j = int(test.length[c]), int(np.searchsorted(begins, p, side="right")) - 1
        if max(covered, int(reach[j]) if j >= 0 else -1) < p + n:
            out.append((p, n, int(test.places(c)[0])))
            covered = p + n
    return sorted(out)


class _Numbers(dict):
    def __missing__(self, _: bytes) -> int:
        return 0


def _scanner(test: TestIndex) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    kind = pa.struct([("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("doc_word", pa.int64()), ("words", pa.int64()), ("item", pa.string()), ("item_word", pa.int64())])))])

    def shard(lists: list[np.ndarray]) -> pa.Array:
        size = np.array([len(x) + 1 for x in lists], np.int64)
        begin = np.cumsum(size) - size
        tokens = np.zeros(int(size.sum()), np.int32)
        for b, x in zip(begin.tolist(), lists, strict=True):
            tokens[b : b + len(x)] = x
        at, window = hits(tokens, test)
        cut = np.searchsorted(at, np.append(begin, len(tokens)))
        rows: list[dict] = [{"items": [], "matches": []} for _ in lists]
        for d in np.flatnonzero(np.diff(cut)).tolist():
            here, of = at[cut[d] : cut[d + 1]] - begin[d], window[cut[d] : cut[d + 1]]
            found = [(p, n, *test.where(place)) for p, n, place in longest(here, of, test)]
            rows[d] = {"items": test.items(np.unique(of)), "matches": [dict(zip(("doc_word", "words", "item", "item_word"), m, strict=True)) for m in found]}
        return pa.array(rows, kind)

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number = _Numbers(test.vocabulary)
        for texts in batches:
            parts, lists, total = [], [], 0
            for t in texts:
                w = words(t.as_py())
                lists.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
                total += len(w)
                if total > SHARD_WORDS:
                    parts.append(shard(lists))
                    lists, total = [], 0
            if lists or not parts:
                parts.append(shard(lists))
            yield pa.concat_arrays(parts)

    return scan


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int | None = None) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """How many blocks there are, and the items of each: bounded, one at a time, by a hash of the item."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    parts = max(1, -(-total * 2 // (block_bytes or BLOCK_BYTES)))
    parts = 1 if total <= (block_bytes or BLOCK_BYTES) else parts
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield parts, [(r["item"], r["text"]) for r in part.collect()]


def scanned(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int = WINDOW) -> DataFrame:
    """docs with __found: the items and matches of each."""
    bounded_batches(docs.sparkSession)
    key = F.struct(F.sha2(F.col(text_col), 256).alias("digest"), F.octet_length(text_col).alias("size"))
    passes = []
    for parts, block in blocks(benchmark):
        found = F.arrow_udf(_scanner(TestIndex(block, window)), FOUND)(F.col(text_col))
        if parts == 1:
            return docs.withColumn("__found", found)
        some = docs.select(key.alias("__key"), run_id().alias("__run"), found.alias("f")).where(F.size("f.matches") > 0)
        # copies of a text have the same hits
        passes.append(stored(some.groupBy("__key", "__run").agg(F.first("f").alias("f")).groupBy("__key").agg(F.first("f").alias("f")), "decontaminate-pass"))
    every = functools.reduce(DataFrame.unionByName, passes).groupBy("__key").agg(F.collect_list("f").alias("f"))
    every = stored(every.select("__key", F.struct(F.flatten(F.transform("f", lambda x: x["items"])).alias("items"), F.flatten(F.transform("f", lambda x: x["matches"])).alias("matches")).cast(FOUND).alias("__found")), "decontaminate-found")
    forget(*passes)
    return attach(docs.withColumns({"__key": key, "__run": row_salt(docs, text_col)}), every, ["__key"], "__run")


def covered(found: Column) -> Column:
    """Words in any match: a sweep over the matches by place."""
    spans = F.array_sort(F.transform(found, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, m: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), m["b"] - F.greatest(s["end"], m["a"]))).alias("n"), F.greatest(s["end"], m["b"]).alias("end"))
    return F.aggregate(spans, start, step)["n"]


@shielded
def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, items: int = ITEMS) -> DataFrame:
    """docs with n_words, n_hit, item_ids, matches (maximal verbatim ones, with places) and contaminated; these replace columns of that name."""
    out = scanned(docs, benchmark, text_col, window)
    none = F.array().cast("array<string>")
    ids = F.array_sort(F.array_distinct(F.coalesce(F.col("__found.items"), none)))
    out = out.withColumns({"__matches": F.array_sort(F.coalesce(F.col("__found.matches"), F.array().cast("array<struct<doc_word:bigint,words:bigint,item:string,item_word:bigint>>"))), "__ids": ids})
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    new = {"n_words": n_words, "n_hit": covered(F.col("__matches")), "item_ids": F.col("__ids"), "matches": F.col("__matches"), "contaminated": F.size("__ids") >= items}
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def brute(texts: dict[int, str | None], items: dict[str, str | None], window: int = WINDOW) -> dict[int, tuple[int, int, list[str]]]:
    """For tests: each document's words, words hit and items, by comparing every place with every window."""
    at = defaultdict(set)
    for name, t in items.items():
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            at[tuple(w[k : k + window])].add(name)
    out = {}
    for i, t in texts.items():
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in at}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in at:
                    hit |= set(range(k, k + n))
                    names |= at[x]
        out[i] = (len(w), len(hit), sorted(names))
    return out
