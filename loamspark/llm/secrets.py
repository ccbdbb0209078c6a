"""Secret scans [native]: trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: a conjunction of disjunctions of trigrams that every match obeys.
`postings` is the index: for each trigram and block of documents the list of the documents that have it, blocks of about BLOCK documents by
a hash of the text, so that no list grows with the corpus. Lists are intersected and united block by
block as the queries say; what is left are the candidates of each rule. They go to the scan as a bitmap of SLOTS rows, 16 MB at most
however many they are, in which strays are possible but no candidate is lost; rules are verified by their
regular expression on candidates only, so strays cost time and change nothing. Rules without mandatory trigrams
scan fully. No text is shuffled.

Defined cases: null text is the empty text and has no spans; offsets are code points, end exclusive;
rules are tried independently, leftmost and non-overlapping each, and matches that fail a rule's
least length are dropped with what they covered; spans that begin together come in the order of RULES;
repeated rows each get their row; an empty table gives an empty result. Time is linear in the spans of a text.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, forget, running, shielded, stored, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: Rules are written so that the JVM's and Python's regular expressions agree.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("hosted", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 0, 39),
)

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
ENOUGH = 4  # trigrams of a string that are asked for
MANY = 32  # strings kept exact while a pattern is read
BLOCK = 4096  # documents of a posting block
SLOTS, BITS = 4096, 32_768  # rows of the candidates' bitmap, and bits of a row


@dataclass(frozen=True)
class Part:
    """A part of a pattern: one of some characters (None: any other), a choice of sequences, or a repetition of either."""

    chars: frozenset[str] | None = None
    choices: tuple[tuple[Part, ...], ...] | None = None
    low: int = 1
    high: int | None = 1


def parsed(pattern: str) -> tuple[Part, ...]:
    """A regular expression as a sequence of parts: literals, classes, groups, alternatives and repetitions; the rest may be anything."""
    at = 0

    def escaped() -> frozenset[str] | None:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return frozenset(chr(int(pattern[at - 2 : at], 16)))
        return None if c.isalnum() else frozenset(c)

    def one_of() -> frozenset[str] | None:
        nonlocal at
        out, plain = set(), pattern[at] != "^"
        first = at
        while pattern[at] != "]" or at == first:
            c = pattern[at]
            at += 1
            if c == "\\":
                e = escaped()
                plain, e = plain and e is not None, e or frozenset()
                out |= e
            elif c == "-" and at - 1 > first and pattern[at] != "]":
                plain = False
            else:
                out.add(c)
        at += 1
        return frozenset(out) if plain else None

    def choices() -> tuple[tuple[Part, ...], ...]:
        nonlocal at
        out: list[list[Part]] = [[]]
        while at < len(pattern) and pattern[at] != ")":
            c = pattern[at]
            at += 1
            if c == "|":
                out.append([])
                continue
            if c == "(":
                if pattern[at] == "?":
                    at = pattern.index(":", at) + 1
                part = Part(choices=choices())
                at += 1
            elif c in "^$":
                continue
            else:
                part = Part(one_of() if c == "[" else escaped() if c == "\\" else None if c == "." else frozenset(c))
            m = re.compile(r"([*+?]|\{(\d+)(,?)(\d*)\})[?+]?").match(pattern, at)
            if m:
                at = m.end()
                low = int(m[2]) if m[2] else int(m[1] == "+")
                high = (1 if m[1] == "?" else None) if not m[2] else int(m[4]) if m[4] else None if m[3] else low
                part = Part(part.chars, part.choices, low, high)
            out[-1].append(part)
        return tuple(map(tuple, out))

    return (Part(choices=choices()),)


def _cross(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    return {x + y for x in a for y in b} if a is not None and b is not None and len(a) * len(b) <= MANY else None


def trigram_query(pattern: str) -> list[list[tuple[str, ...]]]:
    """Clauses that all must hold; a clause is a choice of sets of trigrams, one of which is there as a whole. Lower case."""
    clauses: list[list[tuple[str, ...]]] = []

    def flush(exact: set[str]) -> None:
        sets = [sorted({s[i : i + 3] for i in range(len(s) - 2)}) for s in exact]
        if not all(sets):
            return
        shared = sorted(set.intersection(*map(set, sets)))
        if len(sets) > 1 and len(shared) >= ENOUGH:  # what all choices need says enough
            sets = [shared]
        least = [x for x in sets if not any(set(y) < set(x) for y in sets)]  # a choice that needs more than another adds nothing
        clauses.append(sorted({tuple(x[:: -(-len(x) // ENOUGH)]) for x in least}))

    def once(part: Part) -> set[str] | None:
        if part.choices is None:
            return None if part.chars is None else {c.lower() for c in part.chars}
        found = [exact_of(seq) for seq in part.choices]
        return None if any(f is None for f in found) else set().union(*found)

    def exact_of(seq: tuple[Part, ...]) -> set[str] | None:
        """The strings that a part of a pattern can be, if they are few."""
        now: set[str] | None = {""}
        for part in seq:
            one, some = once(part), None
            if one is not None and part.high is not None and part.high <= 4:
                power: set[str] | None = {""}
                some = {""} if part.low == 0 else set()
                for n in range(1, part.high + 1):
                    power = _cross(power, one)
                    some = None if some is None or power is None else some | power if n >= part.low else some
            now = _cross(now, some)
        return now

    def walk(seq: tuple[Part, ...]) -> None:
        exact: set[str] = {""}
        for part in seq:
            own = exact_of((part,))
            joined = _cross(exact, own)
            if joined is not None:
                exact = joined
                continue
            flush(exact)
            exact = own if own is not None else {""}
            if own is None and part.low > 0 and part.choices is not None and len(part.choices) == 1:
                walk(part.choices[0])
        flush(exact)

    walk(parsed(pattern))
    return clauses


def index_trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams of all rules' queries."""
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for choice in clause for t in choice})


def key_of(text: Column) -> Column:
    """What stands for a text in the lists. A clash only makes a stray candidate."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def postings(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """trigram, block, docs: the keys of a block's documents that have a trigram of the rules."""
    blocks = max(16, docs.count() // BLOCK)
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    has = lambda x: F.array_compact(F.array(*[F.when(F.contains(x, F.lit(t)), F.lit(t)) for t in index_trigrams(rules)]))
    rows = docs.select(key_of(F.col(text_col)).alias("key"), F.explode(bound(low, has)).alias("trigram"))
    return rows.groupBy("trigram", F.pmod("key", F.lit(blocks)).alias("block")).agg(F.collect_set("key").alias("docs"))


def answers(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule (its number), key: the documents that a rule's query leaves, by intersecting and uniting the lists of each block."""
    per = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("lists"))
    of = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), F.array().cast("array<bigint>"))
    found = []
    for k, r in enumerate(rules):
        clauses = [functools.reduce(F.array_union, [functools.reduce(F.array_intersect, map(of, need)) for need in choice]) for choice in trigram_query(r.pattern)]
        if clauses:
            found.append(F.struct(F.lit(k).alias("rule"), functools.reduce(F.array_intersect, clauses).alias("keys")))
    return per.select(F.explode(F.array(*found)).alias("f")).select("f.rule", F.explode("f.keys").alias("key"))


def _slot(key: Column) -> Column:
    return F.pmod(key, F.lit(SLOTS)).cast("int")


def _bit(key: Column, rule: Column) -> Column:
    return F.pmod(F.xxhash64(key, rule), F.lit(BITS))


def candidates(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """slot, bits: the candidates of all rules in SLOTS rows of BITS bits at most."""
    index = stored(postings(docs, text_col, rules), "secrets-postings")
    pairs = answers(index, rules)
    out = stored(pairs.groupBy(_slot(F.col("key")).alias("slot")).agg(F.bitmap_construct_agg(_bit(F.col("key"), F.col("rule"))).alias("bits")), "secrets-candidates")
    forget(index)
    return out


def _told(bits: Column, key: Column, rule: int) -> Column:
    """Whether a candidate's bit is set."""
    bit = _bit(key, F.lit(rule))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (bit % 8).cast("int")) % 2 == 1, F.lit(False))


def _matches(text: Column, rule: Rule) -> Column:
    """All matches in their order: array of (g, w, v), the lengths of the gap before a match, of the match and of its value."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), F.lit(1), F.size(whole))
    return F.arrays_zip(gaps.alias("g"), F.transform(whole, F.length).alias("w"), F.transform(value, F.length).alias("v"))


def _spans(matches: str, rule: Rule, at: int) -> Column:
    """Those that are long enough, as array of (start, rank, kind, end): gaps and matches before one give its place."""
    before = running(f"transform({matches}, r -> r.g + r.w)")
    placed = f"zip_with({matches}, {before}, (r, b) -> named_struct('start', b + r.g, 'rank', {at}, 'kind', '{rule.kind}', 'end', b + r.g + r.w, 'v', r.v))"
    return F.expr(f"transform(filter({placed}, s -> s.v >= {rule.least}), s -> named_struct('start', s.start, 'rank', s.rank, 'kind', s.kind, 'end', s.end))").cast(SPANS)


def _could(text: Column, rule: Rule) -> Column:
    """A cheaper test than listing all matches: one long enough is there. Never false where a match is."""
    m = re.fullmatch(r"((?:[\w-]|\[[^]^]+\])*)(\[[^]^]+\])\+", rule.pattern)
    if m and rule.group == 0:
        return text.rlike(f"{m[1]}{m[2]}{{{max(1, rule.least - len(re.sub(r'\[[^]]*\]', 'x', m[1])))},}}")
    return text.rlike(rule.pattern)


@shielded
def secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with secret_spans: array of (start, rank, kind, end) in their order; replaces a column of that name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = key_of(F.col(text_col))
    gated = [bool(trigram_query(r.pattern)) for r in rules]
    rows = docs
    if any(gated):  # SLOTS rows of BITS bits: a broadcast of a known size
        found = candidates(docs, text_col, rules).select(F.col("slot").alias("__slot"), F.col("bits").alias("__bits"))
        rows = docs.join(F.broadcast(found), _slot(key) == F.col("__slot"), "left")
    none = F.array().cast("array<struct<g:int,w:int,v:int>>")
    gate = [_told(F.col("__bits"), key, k) if gated[k] else F.lit(True) for k in range(len(rules))]
    rows = rows.withColumns({f"__m{k}": F.when(gate[k] & _could(text, r), _matches(text, r)).otherwise(none) for k, r in enumerate(rules)})
    rows = rows.withColumns({f"__s{k}": _spans(f"__m{k}", r, k) for k, r in enumerate(rules)})
    out = F.array_sort(F.concat(*[F.col(f"__s{k}") for k in range(len(rules))]))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c != "secret_spans"], out.alias("secret_spans"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["rank"] < 3)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in RULES[:3]], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secret_spans")).alias("spans"))


def brute(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str, int]]:
    """For tests: the spans of a text by re."""
    return sorted((m.start(), k, r.kind, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text or "", re.ASCII) if len(m[r.group]) >= r.least)


def _sql() -> str:
    def found(k: int, r: Rule) -> str:
        pattern = r.pattern.replace("'", "''")
        return f"""select n, {k} as rank, '{r.kind}' as kind, generate_subscripts(w, 1) as i, unnest(w) as w, unnest(v) as v, unnest(g[1:len(w)]) as g
  from (select n, string_split_regex(t, '{pattern}') as g, regexp_extract_all(t, '{pattern}') as w, regexp_extract_all(t, '{pattern}', {r.group}) as v from d where regexp_matches(t, '{pattern}'))"""

    counts = ", ".join(f"coalesce(sum((kind = '{r.kind}')::int), 0)::bigint as n_{r.kind}" for r in RULES[:3])
    return f"""
with d as (select row_number() over () as n, doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(found(k, r) for k, r in enumerate(RULES))}),
s as (
  select n, rank, kind, stop - length(w) as start, stop, length(v) as size
  from (select *, sum(length(g) + length(w)) over (partition by n, rank order by i) as stop from m)),
kept as (select n, rank, kind, start, kind || ':' || start::bigint || ':' || stop::bigint as span from s where {" or ".join(f"(rank = {k} and size >= {r.least})" for k, r in enumerate(RULES))})
select doc_id, {counts},
       sha256(coalesce(string_agg(span, ',' order by start, rank) filter (rank < 3), '')) as base_sha256,
       coalesce(string_agg(span, ',' order by start, rank), '') as spans
from d left join kept using (n) group by n, doc_id
"""


SQL = {"op1_secrets": _sql()}
