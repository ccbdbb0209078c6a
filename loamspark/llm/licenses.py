"""License scans [native]: trained paragraph classifier.

Paragraphs are runs of lines: comment marks go, and hard-wrapped lines are joined again. A multinomial logistic regression over word 1- to
3-grams, trained on the public texts and notices of license_texts (a bounded set, part of the code) and on prose as class `unknown`, gives a
licence family and a calibrated probability: the temperature is fitted on the scores that each training text gets from a model that has not seen it, and what
stays below CERTAIN is `unknown`. A paragraph is read in windows of WINDOW words, so that a notice is found inside long prose; its best window counts.
A prediction is confirmed if 0.8 or more of the window's five-word shingles (of shorter ones: the whole) are in the family's templates.
Scoring is by Spark expressions: grams are looked up in a table by their hash, and the hash itself is compared, so that no other gram shares a weight.

The model's vocabulary is sparse: a gram is in it only if it has one of ANCHORS in it (or, as a word, of SHORT). Text without any has no feature and the score
of the bias, which is `unknown`; so the scan for anchors skips nothing that the model could tell.

Defined cases: null and empty texts have no paragraphs and no family; a document of several families has
`families` sorted and `family` that of most confirmed paragraphs, then the most probable, then the first by name; repeated rows each
get their row; an empty table gives an empty result; other columns of the result's names are replaced.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, constant, shielded, table
from .license_texts import FRAMES, NAMES, PHRASES, PROSE, SUBJECTS, TEMPLATES

UNKNOWN = "unknown"
#: Substrings and words that every gram of the vocabulary has one of.
ANCHORS = tuple("licens licenc copyright warrant permission redistribut spdx gpl apache mozilla proprietary affero gnu creative common attribution noncommercial sharealike bsd reserved confidential liab domain zlib disclaim unauthorized prohibit rights unencumbered misrepresent endors permitted distribut commercial merchantab contributor".split())
SHORT = ("mit", "isc", "mpl", "cc", "cc0")
SLOTS, EPOCHS, RATE, MOMENTUM, DECAY, FOLDS = 1 << 15, 120, 6.0, 0.9, 2e-5, 3
CERTAIN, SIMILAR, SHINGLE, WINDOW = 0.6, 0.8, 5, 64
WORD = r"[0-9a-z]+"  # without a repeated group, over which the JVM's regular expressions would recurse
_WORD = re.compile(WORD)
_SHORT = rf"(?<![0-9a-z])(?:{'|'.join(SHORT)})(?![0-9a-z])"
#: Marks of comments at a line's start; and the end of a line that was broken by its width: 40 to 100 characters that end in a letter or a comma.
COMMENT, WRAPPED = r"(?m)^[ \t]*(?:#+|//+|\*+|;+|--+|%+)[ \t]+", r"(?m)^((?!SPDX)[^\n]{39,99}[A-Za-z,])[ \t]*\r?\n(?=[ \t]*[^\s])"


def _words(text: str) -> list[str]:
    return _WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


def anchored(text: str) -> bool:
    return any(a in text for a in ANCHORS) or re.search(_SHORT, text) is not None


def _grams(w: list[str]) -> list[str]:
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _hash(gram: str) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def windows(w: list[str]) -> list[list[str]]:
    half = WINDOW // 2
    return [w[k * half : k * half + WINDOW] for k in range(max(1, -(-(len(w) - half) // half)))] if w else []


class Model:
    """Classes (the unknown one first), vocabulary, weights (a row for each gram), bias and temperature."""

    def __init__(self) -> None:
        self.classes = [UNKNOWN, *sorted(TEMPLATES)]
        self.vocabulary = sorted({g for group in (TEMPLATES, NAMES) for texts in group.values() for t in texts for g in _grams(_words(t)) if anchored(g)} | {g for t in PHRASES for g in _grams(_words(t.format("|"))) if anchored(g)})
        self.place = {g: k for k, g in enumerate(self.vocabulary)}
        # held out are whole phrases, frames and prose texts, and stretches of the long texts
        rows = [(0, k % FOLDS, _words(t)) for k, t in enumerate(PROSE)]
        rows += [(0, k % FOLDS, _words(f.format(x))) for k, f in enumerate(FRAMES) for x in SUBJECTS] + [(0, k % FOLDS, []) for k in range(30)]
        for label, y in ((c, k) for k, c in enumerate(self.classes) if k):
            rows += [(y, k % FOLDS, w) for t in TEMPLATES[label] for k, w in enumerate(self._variants(_words(t)))]
            rows += [(y, k % FOLDS, _words(f.format(x))) for k, f in enumerate(PHRASES) for x in NAMES.get(label, ())]
        x, y, fold = self.features([w for *_, w in rows]), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.held = np.zeros((len(y), len(self.classes)))
        for k in range(FOLDS):
            w, b = self._fit(x[fold != k], y[fold != k])
            self.held[fold == k] = x[fold == k] @ w + b
        self.held_class = y
        self.temperature = min(np.geomspace(0.25, 4, 80).tolist(), key=lambda t: -np.log(np.maximum(self._soft(self.held / t)[np.arange(len(y)), y], 1e-12)).mean())
        self.weights, self.bias = self._fit(x, y)

    @staticmethod
    def _variants(w: list[str]) -> list[list[str]]:
        """A text's windows and, of longer ones, overlapping halves."""
        out = windows(w)
        return out + [v[k : k + len(v) // 2] for v in out if len(v) >= 12 for k in (0, len(v) // 4, len(v) // 2)]

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def features(self, lists: list[list[str]]) -> np.ndarray:
        """Known grams, distinct, over the root of the number of words."""
        x = np.zeros((len(lists), len(self.vocabulary)), np.float64)
        for row, w in zip(x, lists, strict=True):
            for g in set(_grams(w)):
                if g in self.place:
                    row[self.place[g]] = 1 / np.sqrt(len(w))
        return x

    def _fit(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        target, share = np.eye(len(self.classes))[y], (1 / np.bincount(y, minlength=len(self.classes)).clip(1))[y][:, None]
        share = share / share.sum() * np.where(y == 0, 3.0, 1.0)[:, None]
        w, b = np.zeros((x.shape[1], len(self.classes))), np.zeros(len(self.classes))
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(EPOCHS):
            g = (self._soft(x @ w + b) - target) * share
            vw = MOMENTUM * vw - RATE * (x.T @ g * 4 + DECAY * w)
            vb = MOMENTUM * vb - RATE * g.sum(axis=0) / 4
            w, b = w + vw, b + vb
        return w, b

    def probabilities(self, lists: list[list[str]]) -> np.ndarray:
        return self._soft((self.features(lists) @ self.weights + self.bias) / self.temperature)

    def shingles(self, family: str) -> list[str]:
        return sorted({" ".join(w[i : i + SHINGLE]) for t in TEMPLATES[family] for w in [_words(t)] for i in range(max(1, len(w) - SHINGLE + 1))})


@functools.cache
def trained() -> Model:
    return Model()


def _table(model: Model) -> tuple[list[int], list[int]]:
    """Places of the grams by slot of their hash, probing onwards: (slot -> 1 + place, or 0), and how far a probe may have to go."""
    slot, far = [0] * SLOTS, 0
    for k, g in enumerate(model.vocabulary):
        at, step = _hash(g) % SLOTS, 0
        while slot[(at + step) % SLOTS]:
            step += 1
        slot[(at + step) % SLOTS] = k + 1
        far = max(far, step)
    return slot, list(range(far + 1))


def classified(paragraph: Column) -> Column:
    """struct(family, probability, confirmed) of a paragraph's best window; family is null for the unknown class."""
    model = trained()
    many = len(model.classes)
    slot, steps = _table(model)
    slots, hashes = constant(slot, "int"), constant(map(_hash, model.vocabulary), "bigint")
    weights = constant((repr(float(v)) for v in model.weights.reshape(-1)), "double")

    def word_list(t: Column) -> Column:
        return F.regexp_extract_all(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))

    def cut(w: Column) -> Column:
        half = WINDOW // 2
        last = F.greatest(F.lit(1), F.ceil((F.size(w) - half) / half).cast("int")) - 1
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(w, k * half + 1, WINDOW))

    def joined(ws: Column, n: int) -> Column:
        return F.transform(F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(ws, i, n), " "))

    def place(h: Column) -> Column:
        """1 + a gram's place, or null."""
        tried = [F.get(slots, F.pmod(h + step, F.lit(SLOTS)).cast("int")) for step in steps]
        return F.coalesce(*[F.when(F.get(hashes, at - 1) == h, at) for at in tried], F.lit(0))

    def of(ws: Column) -> Column:
        hashed = F.array_distinct(F.transform(F.concat(joined(ws, 1), joined(ws, 2), joined(ws, 3)), lambda g: F.xxhash64(g)))
        known = F.filter(F.transform(hashed, place), lambda k: k > 0)
        total = F.aggregate(known, F.array_repeat(F.lit(0.0), many), lambda s, k: F.zip_with(s, F.slice(weights, (k - 1) * many + 1, many), lambda a, c: a + c))
        scale = F.lit(1.0) / F.sqrt(F.greatest(F.lit(1), F.size(ws)))
        scores = F.zip_with(total, constant((repr(float(v)) for v in model.bias), "double"), lambda a, c: (a * scale + c) / float(model.temperature))
        return F.struct(scores.alias("z"), F.array_max(scores).alias("top"), ws.alias("ws"))

    def rated(s: Column) -> Column:
        mass = F.aggregate(s["z"], F.lit(0.0), lambda a, z: a + F.exp(z - s["top"]))
        at = F.array_position(s["z"], s["top"]).cast("int")
        p = F.lit(1.0) / mass
        return F.struct(((at > 1) & (p >= CERTAIN)).alias("sure"), p.alias("p"), at.alias("at"), s["ws"].alias("ws"))

    def verdict(s: Column) -> Column:
        name = F.when(s["sure"], F.get(F.array(*[F.lit(c) for c in model.classes]), s["at"] - 1))
        shingles = F.array_distinct(F.when(F.size(s["ws"]) >= SHINGLE, joined(s["ws"], SHINGLE)).otherwise(F.array(F.array_join(s["ws"], " "))))
        known = F.lit(None).cast("array<string>")
        for c in model.classes[1:]:
            known = F.when(name == c, constant(model.shingles(c), "string", "\n")).otherwise(known)
        like = F.size(F.array_intersect(shingles, known)) / F.size(shingles)
        return F.struct(name.alias("family"), s["p"].alias("probability"), F.coalesce(like >= SIMILAR, F.lit(False)).alias("confirmed"))

    best = lambda rows: F.get(F.array_sort(F.transform(rows, lambda s, i: F.struct((~s["sure"]).alias("unsure"), (-s["p"]).alias("q"), i.alias("i"), s.alias("s")))), F.lit(0))["s"]
    # lambdas bind what they share, so that it is computed once
    rows = lambda cuts: F.transform(F.transform(cuts, of), rated)
    return bound(paragraph, lambda t: bound(bound(word_list(t), cut), lambda cuts: bound(bound(rows(cuts), best), verdict)))


def has_anchor(text: Column) -> Column:
    """Whether the model could have a feature in a text."""
    return bound(F.lower(text), lambda low: functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(a)) for a in ANCHORS]) | low.rlike(_SHORT))


def paragraphs(text: Column) -> Column:
    """The lines of a text without comment marks, hard-wrapped ones joined, without blank ones."""
    whole = F.regexp_replace(F.regexp_replace(text, COMMENT, ""), WRAPPED, "$1 ")
    return F.filter(F.split(whole, r"\r?\n", -1), lambda x: F.trim(x) != "")


RESULT = ("n_paragraphs", "license_spans", "families", "family", "confirmed")


@shielded
def licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_paragraphs, license_spans (paragraph number, family, probability, confirmed), families, family, confirmed."""
    rows = docs.withColumn("__lines", paragraphs(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.withColumn("__cued", F.filter(F.transform("__lines", lambda x, i: F.struct(i.alias("paragraph"), x.alias("t"))), lambda s: has_anchor(s["t"])))
    found = F.transform("__cued", lambda s: F.struct(s["paragraph"].alias("paragraph"), classified(s["t"]).alias("c")))
    hits = F.transform(F.filter(found, lambda s: s["c"]["family"].isNotNull()), lambda s: F.struct(s["paragraph"].alias("paragraph"), s["c"]["family"].alias("family"), F.round(s["c"]["probability"], 6).alias("probability"), s["c"]["confirmed"].alias("confirmed")))
    rows = rows.withColumn("__hits", hits)
    families = F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["family"])))
    per = F.transform(families, lambda f: F.struct((-F.size(F.filter("__hits", lambda h: (h["family"] == f) & h["confirmed"]))).alias("n"), (-F.array_max(F.transform(F.filter("__hits", lambda h: h["family"] == f), lambda h: h["probability"]))).alias("p"), f.alias("f")))
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in RESULT],
        F.size("__lines").cast("long").alias("n_paragraphs"),
        F.col("__hits").alias("license_spans"),
        families.alias("families"),
        F.array_min(per)["f"].alias("family"),
        F.exists("__hits", lambda h: h["confirmed"]).alias("confirmed"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *RESULT)
