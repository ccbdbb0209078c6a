"""Language ID: multilingual mixture inference.

Every learned language has a smoothed model of hashed byte trigrams inside letter words. A document is a mixture:
each word comes from one language, and expectation-maximisation finds the proportions. Languages enter the document's set, largest
proportion first, as long as each raises the log-likelihood by more than PENALTY * ln(words + 1); every set is fitted
anew, so its likelihood and the proportions returned are its own.

Training reads text and non-null lang of documents whose crc32(doc_id as text) mod 3 is not 1, at most about TRAIN_DOCS
of a language (chosen by a hash of the doc_id) and the LANGS languages of most documents; both bounds are parameters, and
texts are read whole. So the model has LANGS * BUCKETS numbers at most, whatever the corpus holds.

Defined cases: null text and text without a letter are `und` with score 0; with nothing to learn from
all are `und`; a null doc_id is neither held out nor learned from; repeated rows count each; an
empty table gives an empty result; a language that ties comes first by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shielded, table

TRAIN_DOCS, LANGS = 4_000, 200
BUCKETS, SMOOTH, FLOOR = 1 << 16, 0.3, 1e-3
ROUNDS, PENALTY = 8, 2.0
#: Floats that one piece of text may need at once.
PIECE = 1_500_000
FOUND = "struct<lang:string,score:double,langs:array<string>,shares:array<double>>"

_WORDS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """A character of Unicode's class L; numerals such as a superscript two or a Roman eight are none."""
    return any(map(str.isalpha, text))


def _bytes(text: str) -> bytes:
    return text.lower().encode().translate(_WORDS)


def _grams(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes that begin and end with spaces: the bucket of the trigram around each letter byte, and where words start among them."""
    a = np.frombuffer(raw, np.uint8)
    letter = np.flatnonzero(a[1:-1] != 32) + 1
    b = a.astype(np.uint32)
    mixed = b[letter - 1] * np.uint32(0x9E3779B1) + b[letter] * np.uint32(0x85EBCA77) + b[letter + 1] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return (mixed & np.uint32(BUCKETS - 1)).astype(np.int64), np.flatnonzero(a[letter - 1] == 32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            n = seen.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
            n += np.bincount(_grams(b" " + _bytes(text.as_py()) + b" ")[0], minlength=BUCKETS)
    for lang, n in seen.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at])], names=["lang", "bucket", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        """counts: a row of BUCKETS for each language."""
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        self.logs = np.ascontiguousarray(np.log((counts + SMOOTH) / (total + SMOOTH * BUCKETS)).astype(np.float32))

    def likelihoods(self, raw: bytes) -> np.ndarray:
        """A column for each word: its likelihood in each language over the largest, with a floor for strays."""
        n, parts, at = len(self.langs), [], 0
        step = max(1 << 16, PIECE // (4 * n))
        while at < len(raw):
            end = at + step
            if end < len(raw):
                end = (raw.find(b" ", end, end + step) + 1) or end
            bucket, start = _grams(b" " + raw[at:end] + b" ")
            if len(start):
                x = np.stack([np.add.reduceat(log[bucket], start) for log in self.logs])
                x -= x.max(axis=0)
                parts.append(np.exp(x) * np.float32(1 - FLOOR) + np.float32(FLOOR))
            at = end
        return np.concatenate(parts, axis=1) if parts else np.zeros((n, 0), np.float32)

    def mixtures(self, q: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words q, documents beginning at first (none is empty): proportions, and which languages are in the set. A row for each language."""
        n = np.diff(np.append(first, q.shape[1]))
        doc = np.repeat(np.arange(len(first)), n)

        def em(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(rounds):
                r = [a * p[doc] for a, p in zip(q, pi, strict=True)]
                total = sum(r[1:], r[0])
                pi = np.stack([np.add.reduceat(x / total, first) for x in r]) / n.astype(np.float32)
            mixed = sum(a * p[doc] for a, p in zip(q, pi, strict=True))
            return pi, np.add.reduceat(np.log(np.maximum(mixed, np.float32(1e-30))), first, dtype=np.float64)

        full, _ = em(np.full((q.shape[0], len(first)), 1 / q.shape[0], np.float32), ROUNDS)
        rank = np.argsort(np.argsort(-full, axis=0, kind="stable"), axis=0, kind="stable")
        size, chosen = np.ones(len(first), np.int64), np.where(rank < 1, np.float32(1), np.float32(0))
        best = em(chosen, 0)[1] - PENALTY * np.log(n + 1)
        for k in range(2, q.shape[0] + 1):
            pi = np.where(rank < k, full + np.float32(1e-6), np.float32(0))
            pi, ll = em(pi / pi.sum(axis=0), ROUNDS)
            value = ll - PENALTY * k * np.log(n + 1)
            better = (value > best) & (size == k - 1)
            if not better.any():
                break
            size, best, chosen = np.where(better, k, size), np.where(better, value, best), np.where(better, pi, chosen)
        return chosen, rank < size

    def predict(self, texts: list[str | None]) -> list[dict]:
        out: list[dict] = [{"lang": "und", "score": 0.0, "langs": [], "shares": []} for _ in texts]
        known = [(i, _bytes(t)) for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        while known:
            part, size = [], 0
            while known and (not part or size + len(known[-1][1]) < PIECE // (4 * len(self.langs))):
                part.append(known.pop())
                size += len(part[-1][1])
            each = [self.likelihoods(raw) for _, raw in part]
            pi, inside = self.mixtures(np.concatenate(each, axis=1), np.cumsum([0, *(x.shape[1] for x in each[:-1])]))
            for (i, _), p, s in zip(part, pi.T.tolist(), inside.T.tolist(), strict=True):
                order = sorted((k for k in range(len(p)) if s[k]), key=lambda k: (-p[k], self.langs[k]))
                out[i] = {"lang": self.langs[order[0]], "score": min(1.0, p[order[0]]), "langs": [self.langs[k] for k in order], "shares": [p[k] for k in order]}
        return out


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Model:
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.where(F.col("t").isNotNull() & F.col("l").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    have = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(LANGS).collect()}
    if not have:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[F.lit(x) for lang, n in have.items() for x in (lang, min(1.0, most / n))])
    chosen = rows.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < F.coalesce(F.try_element_at(share, F.col("l")), F.lit(0.0)) * (1 << 20))
    bounded_batches(docs.sparkSession)
    counts = chosen.select("l", "t").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    langs = sorted(got["lang"].unique()) if len(got) else []
    table_ = np.zeros((len(langs), BUCKETS))
    table_[np.searchsorted(np.array(langs, dtype=object), got["lang"].to_numpy(dtype=object)), got["bucket"].to_numpy(np.int64)] = got["n"] if len(got) else 0
    return Model(langs, table_)


def identified(text: Column, model: Model) -> Column:
    """struct(lang, score, langs, shares) of a text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])
        for texts in batches:
            yield pa.array(model.predict(texts.to_pylist()), kind)

    return F.arrow_udf(run, FOUND)(text)


@shielded
def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs, with its own columns, without those that have no language: null texts and texts without a letter."""
    model = train(docs, id_col, text_col, lang_col)
    bounded_batches(docs.sparkSession)
    if not model.langs:  # nothing was learned: only what can have no language goes
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    return docs.withColumn("__lang", identified(F.col(text_col), model)).where("__lang.lang != 'und'").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bounded_batches(spark)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identified(F.col("text"), train(docs)).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"), F.col("x.langs").alias("langs"), F.col("x.shares").alias("shares"))
