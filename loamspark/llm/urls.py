"""URL filters [native]: association-rule filtering.

Rules of one to three tokens -> verdict are mined from labelled URLs: those of SUPPORT and CONFIDENCE whose antecedent holds no shorter rule of the same
verdict. Single tokens are counted by a group-by. Spark's FP-growth mines the combinations, after two reductions that lose none of them: a token
whose own rule is kept and that the other verdict has too seldom can be in no further rule, and tokens that are in the same
URLs are one item (any of them stands for it). FP-growth has no bound of its own on what it combines, which is exponential in tokens that URLs
share; so the pairs and triples of a URL's items are its input, each with the label. Rules match by an inverted
index, token -> item -> rules, all of it constants of the plan that are looked up by hash: no shuffle and no join.

Fixed rules (host, path) come first; the longest that fits gives the verdict. Training labels are the verdicts that the
fixed rules give to the table's own URLs (the tables label no URL otherwise), at most about SAMPLE of them by a hash. A rule
needs SUPPORT of them, which bounds what comes to the driver: tokens of a URL / SUPPORT rows, whatever the table's size.

Defined cases: null and URLs without `://` have an empty host and path and the default verdict, unless tokens fire; of rules that fire
the most confident wins, then the one of most support, then block; nothing to learn from leaves the
default; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import xxhash
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, constant, shielded, table


@dataclass(frozen=True)
class Fixed:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


FIXED = (
    Fixed("allow", "org/"),
    Fixed("block", "example.org/es/"),
    Fixed("block", "example.org/en/1"),
    Fixed("allow", "com/fr/"),
    Fixed("block", "com/de/"),
)
DEFAULT = "allow"
#: Labelled URLs to mine at most, and bounds of the rules.
SAMPLE, SUPPORT, CONFIDENCE = 100_000, 0.005, 0.9
LABEL = "verdict="


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(h: Column, p: Column, rules: tuple[Fixed, ...] = FIXED) -> tuple[Column, Column]:
    """The rule and its verdict: the longest that fits (then the first listed), else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.rule)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def tokens(h: Column, p: Column) -> Column:
    """Distinct tokens: h:label of the host, p:word of the path with digits made one, in any order."""
    labels = F.filter(F.split(h, r"[.\-:@]"), lambda x: x != "")
    words = F.filter(F.split(F.lower(F.regexp_replace(p, r"[0-9]+", "0")), r"[^0-9\p{L}]+"), lambda x: x != "")
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.transform(words, lambda x: F.concat(F.lit("p:"), x))))


@dataclass
class Mined:
    """Rules over items, the best first, as (items, verdict); and the item that each token stands for."""

    rules: list[tuple[tuple[int, ...], str]]
    item: dict[str, int]


def _place(names: list[str]) -> Callable[[Column], Column]:
    """1 + the place of a string among names, else 0: by its hash, in a table with open slots."""
    size = max(16, 1 << (2 * len(names)).bit_length())
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in names]
    slot, far = [0] * size, 0
    for k, h in enumerate(hashes):
        step = 0
        while slot[(h + step) % size]:
            step += 1
        slot[(h + step) % size], far = k + 1, max(far, step)
    slots, known = constant(slot, "int"), constant(names, "string", "\n")

    def look(x: Column) -> Column:
        tried = [F.get(slots, F.pmod(F.xxhash64(x) + F.lit(step), F.lit(size)).cast("int")) for step in range(far + 1)]
        return F.coalesce(*[F.when(F.get(known, at - 1) == x, at) for at in tried], F.lit(0))

    return look


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> Mined:
    """Of (tokens, verdict) rows, all rules of least length."""
    n = labelled.count()
    least = max(1, math.ceil(support * n - 1e-9))
    verdicts = ("allow", "block")
    rows = labelled.withColumn("id", F.monotonically_increasing_id())
    ones = rows.select("id", "verdict", F.explode("tokens").alias("token")).groupBy("token")
    counts = ones.agg(*[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in verdicts], F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 7))").alias("y"))
    found: list[tuple[tuple[int, ...], str, float, int]] = []
    item: dict[str, int] = {}
    open_: dict[tuple, int] = {}
    for r in counts.where(F.greatest(*verdicts) >= least).orderBy("token").collect():
        total = r["allow"] + r["block"]
        kept = [v for v in verdicts if r[v] >= least and r[v] / total >= confidence]
        if kept and total - r[kept[0]] < least:
            item[r["token"]] = len(item) + (1 << 40)
        else:
            item[r["token"]] = open_.setdefault((r["allow"], r["block"], r["x"], r["y"]), len(open_))
        found += [((item[r["token"]],), v, r[v] / total, r[v]) for v in kept]
    found = sorted(set(found))
    names = [t for t, k in item.items() if k < 1 << 40]
    if len(open_) > 1:
        look, ids = _place(names), constant((item[t] for t in names), "string")
        items = F.array_distinct(F.transform(F.filter(F.transform("tokens", look), lambda k: k > 0), lambda k: F.get(ids, k - 1)))
        several = rows.select(F.array_sort(items).alias("items"), "verdict").where(F.size("items") > 1)
        pairs = "transform(items, (x, i) -> transform(slice(items, i + 2, size(items)), y -> concat(x, '+', y)))"
        triples = "transform(items, (x, i) -> flatten(transform(slice(items, i + 2, size(items)), (y, j) -> transform(slice(items, i + j + 3, size(items)), z -> concat(x, '+', y, '+', z)))))"
        many = several.select(F.explode(F.expr(f"flatten(concat({pairs}, {triples}))")).alias("set"), "verdict").select(F.array("set", F.concat(F.lit(LABEL), "verdict")).alias("items"))
        some = many.count()
        if some >= least:
            model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / some, minConfidence=confidence).fit(many)
            rules = model.associationRules.where(F.col("consequent")[0].startswith(LABEL))
            shorter = {(a, v) for a, v, _, _ in found}
            got = [(tuple(sorted(map(int, r["antecedent"][0].split("+")))), r["consequent"][0][len(LABEL) :], r["confidence"], round(r["support"] * some)) for r in rules.collect()]
            for rule in sorted(got, key=lambda r: (len(r[0]), r)):
                if not any((part, rule[1]) in shorter for k in range(1, len(rule[0])) for part in combinations(rule[0], k)):
                    shorter.add(rule[:2])
                    found.append(rule)
    found.sort(key=lambda r: (-r[2], -r[3], r[1] != "block", r[0]))
    return Mined([(a, v) for a, v, _, _ in found], item)


def fires(tok: Column, mined: Mined) -> Column:
    """The verdict of the best rule whose items are all there, else null. Postings are looked up token by token."""
    used = {i for a, _ in mined.rules for i in a}
    names = [t for t, i in mined.item.items() if i in used]
    if not names:
        return F.lit(None).cast("string")
    listed: dict[int, list[int]] = {}
    for place, (a, _) in enumerate(mined.rules):
        for i in a:
            listed.setdefault(i, []).append(place)
    look = _place(names)
    items, lists = constant((mined.item[t] for t in names), "bigint"), constant((",".join(map(str, listed[mined.item[t]])) for t in names), "string", "\n")
    needs, verdicts = constant((",".join(map(str, a)) for a, _ in mined.rules), "string", "\n"), constant((v for _, v in mined.rules), "string")

    def best(at: Column) -> Column:
        have = F.transform(at, lambda k: F.get(items, k - 1))
        hits = F.array_distinct(F.flatten(F.transform(at, lambda k: F.split(F.get(lists, k - 1), ",").cast("array<int>"))))
        whole = F.filter(hits, lambda r: F.forall(F.split(F.get(needs, r), ",").cast("array<bigint>"), lambda i: F.array_contains(have, i)))
        return F.get(verdicts, F.array_min(whole))

    return bound(F.filter(F.transform(tok, look), lambda k: k > 0), best)


@shielded
def filtered(pages: DataFrame, url_col: str = "url", rules: tuple[Fixed, ...] = FIXED, sample: int = SAMPLE, default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule, verdict; these replace columns of that name."""
    u = F.col(url_col)
    urls = pages.select(u.alias("u"), host(u).alias("h"), path(u).alias("p"))
    rule, verdict = fixed_rule(F.col("h"), F.col("p"), rules)
    known = urls.select("u", tokens(F.col("h"), F.col("p")).alias("tokens"), verdict.alias("verdict")).where("verdict is not null")
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("u"), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    mined = mine(known.select("tokens", "verdict"))
    new = ("host", "path", "rule", "verdict")
    rows = pages.withColumns({"__h": host(u), "__p": path(u)})
    rule, verdict = fixed_rule(F.col("__h"), F.col("__p"), rules)
    rows = rows.withColumns({"__rule": rule, "__fixed": verdict, "__tokens": tokens(F.col("__h"), F.col("__p"))})
    return rows.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in new],
        F.col("__h").alias("host"),
        F.col("__p").alias("path"),
        F.col("__rule").alias("rule"),
        F.coalesce("__fixed", fires(F.col("__tokens"), mined), F.lit(default)).alias("verdict"),
    )


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
