"""Conditional entropies of high orders, where nearly every gram is met once and a row for each would be the whole cost.

Neighbouring grams overlap in all characters but one, so they travel together: a gram's bucket is told by the least hash among the short
grams of its context, which neighbours mostly share, and what is exchanged are stretches of text of one bucket. All grams of a context
are in one bucket. There they are numbered without loss and sorted by numpy; a bucket leaves one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counting
from .counting import bounded_batches, codes, dense, gram_ids, groups_of, ranked

#: Grams of a bucket on average, and of one sort at most.
BUCKET, SORTED = 3 << 20, 4 << 20
#: Different grams that a task holds at most before it passes them on.
HELD = 2 << 20
#: New characters of a stretch at most, so that a byte holds their number.
STRETCH = 255
_ODD = np.uint64(0x9E3779B97F4A7C15)


def buckets(code: np.ndarray, order: int, n: int) -> np.ndarray:
    """For each context of `order` characters its bucket of n: of the least hash of the shorter grams in it."""
    short = order // 2 + 1
    size = len(code) - short + 1
    h = np.zeros(size, np.uint64)
    for j in range(short):
        h = h * _ODD + code[j : j + size]
    least = (((h ^ (h >> np.uint64(29))) * _ODD) >> np.uint64(32)).astype(np.uint32)
    wide, width = order - short + 1, 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wide > width:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    spread = (least.astype(np.uint64) * _ODD) >> np.uint64(32)
    return ((spread * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def stretches(texts: list[str], order: int, n: int, pad: str = "\x02") -> tuple[np.ndarray, list[str], list[bytes]]:
    """Buckets, and for each its stretches of text, one after the other, with the numbers of their characters beyond the first `order`."""
    size = np.array([len(t) for t in texts], np.int64)
    code = codes("".join(pad * order + t for t in texts))
    begin = np.cumsum(size + order) - size - order
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    if not len(at):
        return np.zeros(0, np.int32), [], []
    b = buckets(code, order, n)[at]
    first = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (at[1:] != at[:-1] + 1))))
    length = np.diff(np.append(first, len(b)))
    parts = -(-length // STRETCH)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(first, parts) + nth * STRETCH
    length = np.minimum(np.repeat(length, parts) - nth * STRETCH, STRETCH)
    by = np.argsort(b[first], kind="stable")
    first, length = first[by], length[by]
    whole = length + order
    end = np.cumsum(whole)
    flat = code[np.repeat(at[first] - (end - whole), whole) + np.arange(int(end[-1]))].tobytes().decode("utf-32-le", "surrogatepass")
    own = b[first]
    cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    last = np.append(cut[1:], len(own))
    chars = np.concatenate(([0], end[last - 1])).tolist()
    short = length.astype(np.uint8)
    return own[cut], [flat[i:j] for i, j in zip(chars, chars[1:])], [short[i:j].tobytes() for i, j in zip(cut.tolist(), last.tolist(), strict=True)]


def _sorted_cost(place: np.ndarray, size: int, at: np.ndarray, order: int) -> tuple[int, int, float]:
    """Grams, contexts, and the bits that the last characters cost, of the grams at these places."""
    ctx, room = place[at].astype(np.int64), size
    for j in range(1, order + 1):
        if room > (1 << 62) // size:
            known, ctx = dense(ctx)
            room = len(known)
        ctx *= size
        ctx += place[at + j]
        room *= size
    ctx.sort()
    first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
    n = np.diff(np.append(first, len(ctx)))
    ctx = ctx[first] // size
    cut = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
    total = np.add.reduceat(n, cut)
    return len(at), len(cut), float((total * np.log2(total) - np.add.reduceat(n * np.log2(n), cut)).sum())


def cost(code: np.ndarray, length: np.ndarray, order: int) -> tuple[int, int, float]:
    """_sorted_cost of all grams of stretches, so many contexts at a time as are sorted at once."""
    known, place = ranked(code)
    place = place.astype(np.uint8 if len(known) <= 256 else np.int32)
    whole = length + order
    at = np.repeat(np.cumsum(whole) - whole - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    parts = -(-len(at) // SORTED)
    if parts <= 1:
        return _sorted_cost(place, max(2, len(known)), at, order)
    part = np.empty(len(at), np.uint16)
    for i in range(0, len(at), SORTED):
        some, h = at[i : i + SORTED], np.uint64(0)
        for j in range(order):
            h = (h + place[some + j].astype(np.uint64)) * _ODD
        part[i : i + SORTED] = (h >> np.uint64(40)) % np.uint64(min(parts, 1 << 16))
    n = n_contexts = 0
    bits = 0.0
    for k in range(min(parts, 1 << 16)):
        some = at[part == k]
        if len(some):
            a, b, c = _sorted_cost(place, max(2, len(known)), some, order)
            n, n_contexts, bits = n + a, n_contexts + b, bits + c
    return n, n_contexts, bits


def entropy(df: DataFrame, keys: list[str], text_col: str, order: int) -> DataFrame:
    """keys, n_symbols, n_contexts, bits a symbol, given the `order` characters before it; what stands before a text is padding."""
    bounded_batches(df.sparkSession)
    rows = df.select(*keys, F.col(text_col).alias("__text")).where("__text is not null")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    n = max(1, -(-int(rows.agg(F.sum(F.length("__text"))).first()[0] or 0) // BUCKET))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            for at in groups_of(batch, len(keys)):
                bucket, text, length = stretches([texts[i] for i in at], order, n)
                if len(bucket):
                    same = [batch.column(i).take(pa.array(np.full(len(bucket), at[0]))) for i in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(bucket), pa.array(text, pa.string()), pa.array(length, pa.binary())], names=[*keys, "__bucket", "__text", "__length"])

    def counted(key: tuple, table: pa.Table) -> pa.Table:
        code = codes("".join(table.column("__text").to_pylist()))
        length = np.frombuffer(b"".join(table.column("__length").to_pylist()), np.uint8).astype(np.int64)
        same = {k: table.column(k).slice(0, 1).combine_chunks() for k in keys}
        return pa.table(same | {c: pa.array([v]) for c, v in zip(("n_symbols", "n_contexts", "__h"), cost(code, length, order), strict=True)})

    own = "".join(f"`{k}` {types[k]}, " for k in keys)
    spread_rows = rows.mapInArrow(spread, own + "__bucket int, __text string, __length binary")
    per = spread_rows.groupBy(*keys, "__bucket").applyInArrow(counted, own + "n_symbols bigint, n_contexts bigint, __h double")
    total = per.groupBy(*keys).agg(F.sum("n_symbols").alias("n_symbols"), F.sum("n_contexts").alias("n_contexts"), F.sum("__h").alias("__h"))
    return total.select(*keys, "n_symbols", "n_contexts", F.round(F.col("__h") / F.col("n_symbols"), 6).alias("bits"))


def _costs(code: np.ndarray, n: np.ndarray, order: int, least: int) -> tuple[list[tuple[int, int, int, float]], list[tuple[int, str, int]]]:
    """order, symbols, contexts, bits for each order down to `least`, of grams with counts: those of a context of `least` characters are all here.

    And order, gram, count of the lower orders.
    """
    known, place = ranked(code)
    grams = place.reshape(-1, order + 1)
    size, out, low = max(2, len(known)), [], []
    while order >= 0:
        ids, room = grams[:, 0].copy(), size
        for j in range(1, order + 1):
            if room > (1 << 62) // size:
                seen, ids = dense(ids)
                room = len(seen)
            ids = ids * size + grams[:, j]
            room *= size
        by = np.argsort(ids)
        ids = ids[by]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        whole = grams
        n, grams, ctx = np.add.reduceat(n[by], first), grams[by[first], 1:], ids[first] // size
        if order < least:
            flat = known[whole[by[first]]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            low += [(order, flat[i * (order + 1) : (i + 1) * (order + 1)], m) for i, m in enumerate(n.tolist())]
            order -= 1
            continue
        cut = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
        total = np.add.reduceat(n, cut)
        out.append((order, int(total.sum()), len(cut), float((total * np.log2(total) - np.add.reduceat(n * np.log2(n), cut)).sum())))
        order -= 1
    return out, low


def ladder(df: DataFrame, keys: list[str], text_col: str, order: int, pad: str = "\x02") -> DataFrame:
    """keys, ctx_order, n_symbols, n_contexts, bits for all orders down to 0, from one pass over the texts.

    A task counts its grams before they leave it. The longest go to buckets told by the `least` characters before the last one, where the
    orders down to that are counted by numpy; the few grams of lower orders leave the buckets as rows.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(*keys, F.col(text_col).alias("__text")).where("__text is not null")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    least = min(order, 4)
    n_buckets = max(1, -(-int(rows.agg(F.sum(F.length("__text"))).first()[0] or 0) // (2 * BUCKET)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, columns = counting.Ladder(order), {}, []

        def out(owner: int, grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            h = np.zeros(len(grams), np.uint64)
            for j in range(order - least, order):
                h = (h + grams[:, j]) * _ODD
            b = ((((h ^ (h >> np.uint64(29))) * _ODD) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)
            by = np.argsort(b, kind="stable")
            b, n = b[by], n[by].astype(np.int64)
            cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            ends = list(zip(cut.tolist(), [*cut[1:].tolist(), len(b)], strict=True))
            flat = grams[by].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            same = [c.take(pa.array(np.zeros(len(cut), np.int32))) for c in columns[owner]]
            return pa.RecordBatch.from_arrays([*same, pa.array(b[cut]), pa.array([flat[i * (order + 1) : j * (order + 1)] for i, j in ends], pa.string()), pa.array([n[i:j].tobytes() for i, j in ends], pa.binary())], names=[*keys, "__bucket", "g", "__n"])

        for batch in batches:
            every = batch.column(len(keys)).to_pylist()
            for group in groups_of(batch, len(keys)):
                own = tuple(batch.column(i)[group[0]].as_py() for i in range(len(keys)))
                if own not in owners:
                    owners[own] = len(columns)
                    columns.append([batch.column(i).slice(group[0], 1) for i in range(len(keys))])
                size = np.array([len(every[i]) for i in group], np.int64)
                code = codes("".join(pad * order + every[i] for i in group))
                begin = np.cumsum(size + order) - size - order
                at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                if not len(at):
                    continue
                if not held.learn(code):
                    yield from (out(*x) for x in held.grams())
                    if not held.learn(code):  # more different characters than numbers: counted by themselves
                        held.forget()
                        _, first, n = np.unique(gram_ids(code, order + 1)[at], return_index=True, return_counts=True)
                        yield out(owners[own], code[at[first][:, None] + np.arange(order + 1)], n)
                        continue
                held.add(owners[own], code, at)
                if held.size > 2 * HELD:
                    held.merge()
                    if held.size > HELD:
                        yield from (out(*x) for x in held.grams())
        yield from (out(*x) for x in held.grams())

    def counted(key: tuple, table: pa.Table) -> pa.Table:
        code = codes("".join(table.column("g").to_pylist()))
        n = np.frombuffer(b"".join(table.column("__n").to_pylist()), np.int64)
        high, low = _costs(code, n, order, least)
        rows = [(*x, None, None) for x in high] + [(k, None, None, None, g, m) for k, g, m in low]
        kinds = (("ctx_order", pa.int32()), ("n_symbols", pa.int64()), ("n_contexts", pa.int64()), ("__h", pa.float64()), ("g", pa.string()), ("n", pa.int64()))
        same = {k: table.column(k).combine_chunks().take(pa.array(np.zeros(len(rows), np.int64))) for k in keys}
        return pa.table(same | {name: pa.array(v, kind) for (name, kind), v in zip(kinds, zip(*rows, strict=True), strict=True)})

    own = "".join(f"`{k}` {types[k]}, " for k in keys)
    made = rows.mapInArrow(run, own + "__bucket int, g string, __n binary")
    per = made.groupBy(*keys, "__bucket").applyInArrow(counted, own + "ctx_order int, n_symbols bigint, n_contexts bigint, __h double, g string, n bigint")
    known = [F.sum(c).alias(c) for c in ("n_symbols", "n_contexts", "__h")]
    whole = per.groupBy(*keys, "ctx_order", "g").agg(F.sum("n").alias("n"), *known)
    ctx = whole.groupBy(*keys, "ctx_order", F.left("g", F.col("ctx_order")).alias("__ctx")).agg(F.sum("n").alias("__t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("__s"), *known)
    h = F.coalesce("__h", F.col("__t") * F.log2(F.col("__t").cast("double")) - F.col("__s"))
    total = ctx.groupBy(*keys, "ctx_order").agg(F.sum(F.coalesce("n_symbols", "__t")).alias("n_symbols"), F.sum(F.coalesce("n_contexts", F.lit(1).cast("bigint"))).alias("n_contexts"), F.sum(h).alias("__h"))
    return total.select(*keys, "ctx_order", "n_symbols", "n_contexts", F.round(F.col("__h") / F.col("n_symbols"), 6).alias("bits"))
