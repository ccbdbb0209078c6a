"""Repetitions within a text: last earlier occurrences, runs, lags, record periods.

All of it stays within a row: numpy sorts a text's gram numbers and compares neighbours. No character is ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .counting import codes, dense, gram_ids

MATCHED = "struct<n_places:bigint,n_matched:bigint,sum_gap:bigint>"
RUNS = "struct<n_runs:bigint,length:int,gap:int,start:int>"
SEEN = "struct<n:bigint,seen:bigint,most:bigint>"
VOTES = "array<struct<period:int,votes:bigint>>"


def _per_text(text: Column, kind: str, arrow: pa.DataType, one: Callable[[str], object]) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t.as_py() is None else one(t.as_py()) for t in texts], arrow)

    return F.arrow_udf(run, kind)(text)


def last_places(ids: np.ndarray) -> np.ndarray:
    """For each place the latest earlier one with the same number, else -1."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), -1, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def match_sums(ids: np.ndarray) -> tuple[int, int, int]:
    """Places, those whose number was seen before, and how far back it last was in all: for a number, from its first place to its last."""
    n = len(ids)
    if not n:
        return 0, 0, 0
    room = n.bit_length()
    if int(ids.max()) >> (62 - room):
        _, ids = dense(ids)
    key = np.sort((ids << room) | np.arange(n))
    number, place = key >> room, key & ((1 << room) - 1)
    new = np.flatnonzero(number[1:] != number[:-1])
    return n, n - len(new) - 1, int(place[new].sum() + place[-1] - place[new + 1].sum() - place[0])


def folded(code: np.ndarray) -> np.ndarray:
    """Capital letters A to Z as small ones."""
    return np.where((code >= 65) & (code <= 90), code + np.uint32(32), code)


def letter_classes(code: np.ndarray) -> np.ndarray:
    """Letters a to z of either case as a, digits as 0."""
    code = folded(code)
    return np.where((code >= 97) & (code <= 122), np.uint32(97), np.where((code >= 48) & (code <= 57), np.uint32(48), code))


def matches_by_view(text: Column, views: dict[str, tuple[Callable[[np.ndarray], np.ndarray] | None, int, int]]) -> Column:
    """By view, struct(n_places, n_matched, sum_gap): places of k characters (every stride-th), those seen before, and how far back in all.

    A view is what becomes of the code points (None: nothing), k and stride. One worker makes all views of a text.
    """
    names = ("n_places", "n_matched", "sum_gap")
    arrow = pa.struct([(v, pa.struct([(n, pa.int64()) for n in names])) for v in views])

    def one(t: str) -> dict:
        code, made, out = codes(t), {}, {}
        for view, (change, k, stride) in views.items():
            if change not in made:
                made[change] = code if change is None else change(code)
            out[view] = dict(zip(names, match_sums(gram_ids(made[change], k, stride)), strict=True))
        return out

    return _per_text(text, f"struct<{','.join(f'`{v}`:{MATCHED}' for v in views)}>", arrow, one)


def last_matches(text: Column, k: int, stride: int = 1) -> Column:
    """struct(n_places, n_matched, sum_gap) of the text as it is."""
    return matches_by_view(text, {"m": (None, k, stride)})["m"]


def match_runs(text: Column, k: int, recover: int = 1) -> Column:
    """struct(n_runs, length, gap, start) of matches on one distance that follow each other, over at most `recover` places that do not match.

    The longest run; ties go to the smallest gap, then the earliest. Null without a match.
    """
    arrow = pa.struct([("n_runs", pa.int64()), ("length", pa.int32()), ("gap", pa.int32()), ("start", pa.int32())])

    def one(t: str) -> dict | None:
        prev = last_places(gram_ids(codes(t), k))
        pos = np.flatnonzero(prev >= 0)
        if not len(pos):
            return None
        gap = pos - prev[pos]
        by = np.lexsort((pos, gap))
        pos, gap = pos[by], gap[by]
        first = np.flatnonzero(np.concatenate(([True], (gap[1:] != gap[:-1]) | (pos[1:] - pos[:-1] > 1 + recover))))
        last = np.append(first[1:], len(pos)) - 1
        length = pos[last] - pos[first] + k
        best = np.lexsort((pos[first], gap[first], -length))[0]
        return {"n_runs": len(first), "length": int(length[best]), "gap": int(gap[first[best]]), "start": int(pos[first[best]])}

    return _per_text(text, RUNS, arrow, one)


def seen_within(text: Column, window: int) -> Column:
    """struct(n, seen, most): over the places, how often a character occurred among the window before it, summed and at most."""
    arrow = pa.struct([("n", pa.int64()), ("seen", pa.int64()), ("most", pa.int64())])

    def one(t: str) -> dict | None:
        c = codes(t)
        if not len(c):
            return None
        _, place = dense(c)
        order = np.argsort(place, kind="stable")
        base = place[order] * len(c)
        key = base + order
        seen = np.arange(len(c)) - np.searchsorted(key, np.maximum(base, key - window))
        return {"n": len(c), "seen": int(seen.sum()), "most": int(seen.max())}

    return _per_text(text, SEEN, arrow, one)


def lag_similarity(text: Column, most: int) -> Column:
    """Mean circular distance of code points (modulo 256) at each lag from 1 to most, rounded; null where the text is not longer."""

    def one(t: str) -> list:
        x, row = (codes(t) % 256).astype(np.int16), []
        for d in range(1, most + 1):
            a = np.abs(x[d:] - x[:-d])
            row.append(math.floor(int(np.minimum(a, 256 - a).sum(dtype=np.int64)) / len(a) * 1e6 + 0.5) / 1e6 if len(a) else None)
        return row

    return _per_text(text, "array<double>", pa.list_(pa.float64()), one)


def period_votes(text: Column) -> Column:
    """(period, votes): four equal gaps between occurrences of one character; the fourth counts up to 32, two more up to 10."""

    def one(t: str) -> list[dict]:
        _, place = dense(codes(t))
        order = np.argsort(place, kind="stable")
        symbol, n = place[order], len(order)
        back = []
        for k in range(1, 7):
            gap = np.full(n, -1, np.int64)
            if n > k:
                gap[k:] = np.where(symbol[k:] == symbol[:-k], order[k:] - order[:-k], -1)
            back.append(gap)
        r = back[0]
        even = (r > 1) & (back[1] == 2 * r) & (back[2] == 3 * r) & ((r > 32) | (back[3] == 4 * r))
        even &= (r > 10) | ((back[4] == 5 * r) & (back[5] == 6 * r))
        return [{"period": int(p), "votes": int(v)} for p, v in zip(*np.unique(r[even], return_counts=True), strict=True)]

    return _per_text(text, VOTES, pa.list_(pa.struct([("period", pa.int32()), ("votes", pa.int64())])), one)


def first_difference(a: Column, b: Column) -> Column:
    """The first place, from 0, where two texts differ, or null if they are equal: by halving, on prefixes."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    most = F.least(F.length(a), F.length(b))
    grow = lambda n, s: F.when((n + s <= most) & (F.left(a, n + s) == F.left(b, n + s)), n + s).otherwise(n)
    return F.when(a != b, F.aggregate(steps, F.lit(0), grow))
