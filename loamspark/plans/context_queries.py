"""Queries on contexts, histories, repetitions, records and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as T
from ..operators import counting as C
from ..operators import entropy as E
from ..operators import grams as G
from ..operators import repeats as R
from ..operators import sequences as S
from ..sources.tables import table
from .text_queries import FOLD, WORDS, _pairs, docs


def order_entropy(order: int, key: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        if order in HIGH_ORDERS:
            return G.entropy(docs(spark, sf, key, "text"), [key], "text", order)
        counts = C.gram_counts(docs(spark, sf, key, "text"), [key], "text", order)
        return E.conditional(counts.select(key, F.left("g", F.lit(order)).alias("ctx"), "n"), [key], ["ctx"])

    return query


HIGHEST = 6
HIGH_ORDERS = (8, 11, 14)


def order_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Orders 6 to 0 from one pass over the texts."""
    return G.ladder(docs(spark, sf, "lang", "text"), ["lang"], "text", HIGHEST)


def skip_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The character given the two before the last one."""
    counts = C.gram_counts(docs(spark, sf, "lang", "text"), ["lang"], "text", 3)
    skipped = counts.groupBy("lang", F.left("g", F.lit(2)).alias("ctx"), F.right("g", F.lit(1)).alias("c")).agg(F.sum("n").alias("n"))
    return E.conditional(skipped, ["lang"], ["ctx"])


def char_group_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The character given the shape of the five before it: grams are counted first, then grouped by shape."""
    counts = C.gram_counts(docs(spark, sf, "lang", "text"), ["lang"], "text", 5)
    shaped = counts.groupBy("lang", T.shape(F.left("g", F.lit(5))).alias("ctx"), F.right("g", F.lit(1)).alias("c")).agg(F.sum("n").alias("n"))
    return E.conditional(shaped, ["lang"], ["ctx"])


def chart_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Words given the last two letters of the word before and its initial: class slots of the history."""
    slots = C.pair_counts(docs(spark, sf, "text"), [], "text", a={"initial": (0, 1), "ending": (-2, None)})
    return E.conditional(slots, [], ["initial", "ending"])


def word_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Bits a word, given the word before."""
    return E.conditional(C.pair_counts(docs(spark, sf, "lang", "text"), ["lang"], "text"), ["lang"], ["a"])


#: Contexts of the word before, as Spark and as SQL have them.
WORD_CONTEXTS = {
    "word": ("a", "a"),
    "initial": ("left(a, 1)", "left(a, 1)"),
    "first2": ("left(a, 2)", "left(a, 2)"),
    "first3": ("left(a, 3)", "left(a, 3)"),
    "ending": ("right(a, 2)", "right(a, 2)"),
    "last3": ("right(a, 3)", "right(a, 3)"),
    "last4": ("right(a, 4)", "right(a, 4)"),
    "length": ("cast(length(a) as string)", "length(a)::varchar"),
    "ends": ("concat(left(a, 1), right(a, 1))", "left(a, 1) || right(a, 1)"),
    "ending_length": ("concat(right(a, 2), cast(length(a) as string))", "right(a, 2) || length(a)"),
    "consonants": ("regexp_replace(a, '[aeiou]', '')", "regexp_replace(a, '[aeiou]', '', 'g')"),
    "vowels": ("regexp_replace(a, '[^aeiou]', '')", "regexp_replace(a, '[^aeiou]', '', 'g')"),
    "classes": ("regexp_replace(regexp_replace(a, '[aeiou]', 'a'), '[b-df-hj-np-tv-z]', 'b')", "regexp_replace(regexp_replace(a, '[aeiou]', 'a', 'g'), '[b-df-hj-np-tv-z]', 'b', 'g')"),
}


def text_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Bits of a word's initial under many contexts of the word before. One count of word pairs serves all."""
    pairs = C.pair_counts(docs(spark, sf, "text"), [], "text", b={"c": (0, 1)})
    ctx = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(x).alias("ctx")) for k, (x, _) in WORD_CONTEXTS.items()])
    rows = pairs.select(F.explode(ctx).alias("k"), "c", "n").groupBy("k.kind", "k.ctx", "c").agg(F.sum("n").alias("n"))
    return E.conditional(rows, ["kind"], ["ctx"])


def context_history(spark: SparkSession, sf: str) -> DataFrame:
    """For each two-character context: its occurrences, symbols and the most frequent next symbol (then the first)."""
    n = C.gram_counts(docs(spark, sf, "text"), [], "text", 2)
    return n.groupBy(F.left("g", F.lit(2)).alias("ctx")).agg(F.sum("n").alias("n_seen"), F.count("*").alias("n_symbols"), F.min(F.struct((-F.col("n")).alias("m"), F.right("g", F.lit(1)).alias("c")))["c"].alias("top"))


def next_bit_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """P(next bit) of the texts' UTF-8 bytes, from their counts: a byte model read as a bit model."""
    return E.bit_probabilities(C.byte_counts(docs(spark, sf, "lang", "text"), ["lang"], "text"), ["lang"])


def laplace_bit_prob(spark: SparkSession, sf: str) -> DataFrame:
    return E.laplace(table(spark, sf, "labels"), ["quality"], "toxic")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


def event_type_markov(spark: SparkSession, sf: str) -> DataFrame:
    """Types given the two before in a user's history."""
    rows = S.lagged(events(spark, sf), ["user_id"], "event_id", "event_type", 2)
    return rows.groupBy(F.col("lag2").alias("last2"), F.col("lag1").alias("last1"), "event_type").agg(F.count("*").alias("n"))


def event_run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return S.islands(events(spark, sf), ["user_id"], "event_id", "event_type").groupBy("event_type", "length").agg(F.count("*").alias("n"))


def indirect_history(spark: SparkSession, sf: str) -> DataFrame:
    """The two symbols that followed a context the last two times in a user's history, and what followed now."""
    rows = S.lagged(events(spark, sf), ["user_id"], "event_id", "event_type", 1).withColumnRenamed("lag1", "ctx").where("ctx is not null")
    rows = S.lagged(rows, ["user_id", "ctx"], "event_id", "event_type", 2)
    return rows.groupBy("ctx", F.col("lag2").alias("h2"), F.col("lag1").alias("h1"), "event_type").agg(F.count("*").alias("n"))


def high(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "user_id", "event_type", (F.col("value") > 50).cast("bigint").alias("y"))


def bit_history_states(spark: SparkSession, sf: str) -> DataFrame:
    """P(y) by bounded counts (n0, n1) seen before in the user's history: a state map. Running counts come in two levels."""
    past = S.running(high(spark, sf), ["user_id"], "event_id", {"n1": F.col("y"), "n0": 1 - F.col("y")})
    state = [F.least(F.lit(7), F.col(c)).alias(c) for c in ("n0", "n1")]
    return E.laplace(past.select(F.struct(*state).alias("s"), "y"), ["s"], "y").select("s.n0", "s.n1", "n", "p")


def running_mean_error(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cost of y under the user's own running mean (2 n1 + 1) / (2 n + 2)."""
    past = S.running(high(spark, sf), ["user_id"], "event_id", {"n1": F.col("y"), "n": F.lit(1)})
    p = (2 * F.col("n1") + 1) / (2 * F.col("n") + 2)
    return past.groupBy("event_type").agg(F.count("*").alias("n_events"), F.round(F.avg(M.cost(F.when(F.col("y") == 1, p).otherwise(1 - p))), 6).alias("bits"))


def fast_slow_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return S.ema(high(spark, sf), ["user_id"], "event_id", "y", {"slow": 1 / 64, "fast": 1 / 16})


def loss_history(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cost of a user's last eight events under the type's overall probability."""
    e = events(spark, sf)
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    total = n.agg(F.collect_list(F.struct("event_type", "n")).alias("all"))  # a row for each type of a fixed set
    total = total.select(F.explode("all").alias("x"), F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("total"))
    p = total.select("x.event_type", M.cost(F.col("x.n") / F.col("total")).alias("bits"))
    rows = S.lagged(e.join(p, "event_type"), ["user_id"], "event_id", "bits", 7)
    last = F.array_compact(F.array("bits", *[f"lag{k}" for k in range(1, 8)]))
    loss = F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last)
    return rows.groupBy("user_id").agg(F.round(F.max(loss), 6).alias("max_loss"), F.count("*").alias("n"))


def residual_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals of 2N-NN over an order's lines, binned, with the cumulative share by flag."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    q = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select("l_returnflag", (q - (2 * F.lag(q, 1).over(w) - F.lag(q, 2).over(w))).alias("r")).where("r is not null")
    bins = rows.groupBy("l_returnflag", F.floor(F.col("r") / 10).alias("bin")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("l_returnflag")
    return bins.select("l_returnflag", "bin", "n", F.round(F.sum("n").over(by.orderBy("bin")) / F.sum("n").over(by), 6).alias("cdf"))


def column_extrapolation(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute residuals of N, 2N-NN and 3N-3NN+NNN on price and quantity of an order's lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    names = ("l_quantity", "l_extendedprice")

    def residuals(name: str) -> list:
        c, (n1, n2, n3) = F.col(name), (F.lag(name, k).over(w) for k in (1, 2, 3))
        return [(c - n1).alias(f"{name}1"), (c - 2 * n1 + n2).alias(f"{name}2"), (c - 3 * n1 + 3 * n2 - n3).alias(f"{name}3")]

    rows = table(spark, sf, "lineitem").select(*[r for name in names for r in residuals(name)])
    total = rows.agg(*[F.round(F.avg(F.abs(f"{name}{k}")), 4).alias(f"{name}{k}") for name in names for k in (1, 2, 3)], *[F.count(f"{name}3").alias(f"{name}n") for name in names])
    each = F.array(*[F.struct(F.lit(name).alias("name"), *[F.col(f"{name}{k}").alias(f"order{k}") for k in (1, 2, 3)], F.col(f"{name}n").alias("n")) for name in names])
    return total.select(F.inline(each))


def sliding_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """How often a character occurred among the 256 before it, by language: mean."""
    rows = docs(spark, sf, "lang", "text").select("lang", R.seen_within(F.col("text"), 256).alias("s")).where("s is not null")
    return rows.groupBy("lang").agg(F.round(F.sum("s.seen") / F.sum("s.n"), 6).alias("mean_seen"), F.max("s.most").alias("max_seen"))


def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Recalibration: the mean label by bin of a logit and by quality, with n."""
    x = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    z = M.stretch(F.col("n_chars") / (F.col("n_chars") + 2000.0))
    return x.groupBy("quality", F.floor(z * 2).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 6).alias("p"))


def interpolated_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's p: between the two nearest nodes of a 24-node table over the logit, by distance; then the mean cost by quality."""
    x = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    z = (M.stretch(F.col("n_chars") / (F.col("n_chars") + 2000.0)) + 8) * (23 / 16)
    rows = x.select("quality", "toxic", F.floor(z).alias("low"), (z - F.floor(z)).alias("part"))
    ends = rows.select("quality", "toxic", F.explode(F.array(F.struct(F.col("low").alias("node"), (1 - F.col("part")).alias("w")), F.struct((F.col("low") + 1).alias("node"), F.col("part").alias("w")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(((F.sum(F.col("e.w") * F.col("toxic")) + 0.5) / (F.sum("e.w") + 1)).alias("p"))
    joined = rows.join(F.broadcast(nodes.select(F.col("node").alias("low"), F.col("p").alias("p0"))), "low").join(F.broadcast(nodes.select((F.col("node") - 1).alias("low"), F.col("p").alias("p1"))), "low")
    p = F.col("p0") * (1 - F.col("part")) + F.col("p1") * F.col("part")
    return joined.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg(M.cost(F.when(F.col("toxic") == 1, p).otherwise(1 - p))), 6).alias("bits"))


def linear_fit_by_user(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("event_id").cast("double")
    return events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.regr_slope(F.col("value"), x), 6).alias("slope"), F.round(F.regr_r2(F.col("value"), x), 6).alias("r2"))


def archive_totals(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text").cast("bigint")
    return docs(spark, sf, "source", "lang", "text").rollup("source", "lang").agg(F.count("*").alias("n_blocks"), F.sum(size).alias("bytes"), F.sum(M.vli_cost(size).cast("bigint")).alias("header_bytes"))


def archive_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as blocks of their source's archive: where each begins. Starts are running sums in two levels."""
    rows = docs(spark, sf, "doc_id", "source", "text").select("doc_id", "source", F.octet_length("text").cast("bigint").alias("length"), F.when(F.col("text").contains("\r\n") & ~F.col("text").rlike("(?:^|[^\r])\n"), "TEXT_EOL").otherwise("TEXT").alias("type"))
    return S.running(rows, ["source"], "doc_id", {"start": F.col("length")})


def scalar_maths(spark: SparkSession, sf: str) -> DataFrame:
    k, v = F.col("l_orderkey"), F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(M.ilog2(k).alias("ilog2"), M.log_scaled(k).alias("llog"), F.bit_count(k).alias("ones"), M.vli_cost(k * 1000).alias("vli"), M.leading_zeros(k).alias("clz"), M.circular(F.pmod(k, F.lit(256)), F.pmod(k * 7, F.lit(256))).alias("dist"), M.paeth(*[F.pmod(k * m, F.lit(256)) for m in (1, 7, 13)]).alias("paeth"), F.round(M.stretch(v / 51), 6).alias("logit"), F.round(M.squash((v - 25) / 10), 6).alias("p"))
    return rows.groupBy("ilog2", "vli", "clz").agg(F.count("*").alias("n"), F.sum("llog").alias("llog"), F.sum("ones").alias("ones"), F.sum("dist").alias("dist"), F.sum("paeth").alias("paeth"), F.round(F.sum("logit"), 3).alias("logit"), F.round(F.sum("p"), 3).alias("p"))


K = 9


def last_match_kgram(spark: SparkSession, sf: str) -> DataFrame:
    m = docs(spark, sf, "lang", "text").where(F.length("text") >= K).select("lang", R.last_matches(F.col("text"), K).alias("m"))
    return m.groupBy("lang").agg(*[F.sum(f"m.{c}").alias(c) for c in ("n_places", "n_matched", "sum_gap")])


def match_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The longest repeated passage of each document; ties go to the most recent (the smallest gap), then the earliest."""
    return docs(spark, sf, "doc_id", "text").select("doc_id", R.match_runs(F.col("text"), K).alias("r")).where("r is not null").select("doc_id", "r.*")


def masked_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Matches under four views: folded case, plain, every second character, character classes only. One pass over the texts."""
    views = {"folded": (R.folded, 5, 1), "plain": (None, 4, 1), "stride2": (R.folded, 5, 2), "classes": (R.letter_classes, 12, 1)}
    rows = docs(spark, sf, "text").select(R.matches_by_view(F.col("text"), views).alias("m"))
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"m.{k}").alias("m")) for k in views])).alias("e"))
    return each.groupBy("e.kind").agg(*[F.sum(f"e.m.{c}").alias(c) for c in ("n_places", "n_matched", "sum_gap")])


def lag_similarity_best(spark: SparkSession, sf: str) -> DataFrame:
    """The lag of 1 to 32 at which a document is most like itself."""
    s = docs(spark, sf, "doc_id", "text").select("doc_id", R.lag_similarity(F.col("text"), 32).alias("s"))
    least = F.array_min("s")
    return s.where(least.isNotNull()).select("doc_id", F.array_position("s", least).cast("int").alias("lag"), least.alias("distance"))


LINES = 100


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Files of fixed-width records: the lines of LINES orders each."""
    wide = lambda c, n: F.lpad(F.col(c).cast("string"), n, " ")
    rec = F.concat(wide("l_orderkey", 10), wide("l_linenumber", 2), wide("l_partkey", 8), F.lpad(F.col("l_quantity").cast("int").cast("string"), 4, " "), F.col("l_returnflag"), F.col("l_linestatus"), F.lit("\n"))
    rows = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / LINES).alias("file"), F.struct("l_orderkey", "l_linenumber", rec.alias("r")).alias("s"))
    return rows.groupBy("file").agg(F.sort_array(F.collect_list("s")).alias("s")).select("file", F.array_join(F.transform("s", lambda x: x["r"]), "").alias("content"))


def record_period_vote(spark: SparkSession, sf: str) -> DataFrame:
    votes = records(spark, sf).select(F.inline(R.period_votes(F.col("content")))).groupBy("period").agg(F.sum("votes").alias("votes"))
    return votes.orderBy(F.desc("votes"), "period").limit(5)


def first_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against that of the next id."""
    d = docs(spark, sf, "doc_id", "text")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(after, "doc_id").select("doc_id", R.first_difference(F.col("text"), F.col("other")).alias("place"))


def block_type_markov(spark: SparkSession, sf: str) -> DataFrame:
    """Types of a page's pieces (markup, text, script, comment) given the three before."""
    kind = lambda x: F.when(x.startswith("<!--"), "comment").when(x.rlike("(?i)^<(?:script|style)"), "code").when(x.startswith("<"), "markup").otherwise("text")
    pieces = T.extract(F.col("html"), r"(?s)<!--.*?-->|<(?:script|style).*?</(?:script|style)>|<[^>]*>|[^<]+")
    rows = table(spark, sf, "pages").select(F.transform(pieces, kind).alias("k"))
    each = F.transform("k", lambda x, i: F.struct(*[F.when(i >= j, F.get("k", i - j)).alias(f"before{j}") for j in (1, 2, 3)], x.alias("type")))
    return rows.select(F.inline(each)).where("before1 is not null").groupBy("before3", "before2", "before1", "type").agg(F.count("*").alias("n"))


NAMED = {f"order{k}_entropy_by_lang": order_entropy(k, "lang") for k in HIGH_ORDERS} | {"order0_entropy_by_lang": order_entropy(0, "lang"), "order1_entropy_by_lang": order_entropy(1, "lang"), "order2_entropy_by_source": order_entropy(2, "source")}
QUERIES = NAMED | {f.__name__: f for f in (order_ladder, skip_contexts, char_group_contexts, chart_contexts, word_contexts, text_contexts, context_history, next_bit_probabilities, laplace_bit_prob, event_type_markov, event_run_lengths, indirect_history, bit_history_states, running_mean_error, fast_slow_estimates, loss_history, residual_histogram, column_extrapolation, sliding_histogram, calibration_bins, interpolated_calibration, linear_fit_by_user, archive_totals, archive_catalog, scalar_maths, last_match_kgram, match_runs, masked_matches, lag_similarity_best, record_period_vote, first_difference, block_type_markov)}


def _grams(order: int, keys: str) -> str:
    """A row for each character, with the order characters before it as ctx."""
    back = " || ".join(f"coalesce(lag(c, {k}) over w, chr(2))" for k in range(order, 0, -1)) or "''"
    return f"(select {keys}, {back} as ctx, c from (select doc_id, {keys}, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from documents where text != '') window w as (partition by doc_id order by i))"


def _conditional(source: str, keys: str, ctx: str, symbol: str) -> str:
    """source has a row for each occurrence."""
    k = f"{keys}, " if keys else ""
    return f"""
select {k}sum(n)::bigint as n_symbols, count(distinct ({ctx})) as n_contexts, round(sum(n * -log2(n / t)) / sum(n), 6) as bits
from (select *, sum(n) over (partition by {k}{ctx}) as t from (select {k}{ctx}, {symbol}, sum(n)::double as n from {source} group by all)) {'group by ' + keys if keys else ''}"""


def _ones(source: str) -> str:
    return f"(select *, 1 as n from {source})"


def _matches(text: str, k: int, stride: int = 1) -> str:
    at = [f"lead(c, {j * stride}) over w" for j in range(1, k)]
    return f"""(select doc_id, lang, i - 1 as pos, lag(i - 1) over (partition by doc_id, g order by i) as prev from
(select doc_id, lang, i, c || {' || '.join(at)} as g from (select doc_id, lang, unnest(string_split({text}, '')) as c, generate_subscripts(string_split({text}, ''), 1) as i from documents where text != '') window w as (partition by doc_id order by i)) where g is not null)"""


_EVENTS = "e as (select event_id, user_id, event_type, value, (value > 50)::int as y from events)"
_STRETCH = "greatest(-8, least(8, ln(p / (1 - p))))"
_P = "x as (select quality, toxic, n_chars / (n_chars + 2000.0) as p from labels join documents using (doc_id))"
_AGG = "count(*) as n_places, count(prev) as n_matched, sum(pos - prev)::bigint as sum_gap"
_BITS = "case when k <= 0 then 0 else length(bin(k)) end"

SQL = {f"order{k}_entropy_by_lang": _conditional(_ones(_grams(k, "lang")), "lang", "ctx", "c") for k in HIGH_ORDERS} | {
    "order0_entropy_by_lang": _conditional(_ones(_grams(0, "lang")), "lang", "ctx", "c"),
    "order1_entropy_by_lang": _conditional(_ones(_grams(1, "lang")), "lang", "ctx", "c"),
    "order2_entropy_by_source": _conditional(_ones(_grams(2, "source")), "source", "ctx", "c"),
    "order_ladder": f"with g as materialized (select lang, ctx, c, count(*) as n from {_grams(HIGHEST, 'lang')} group by all) " + " union all ".join(f"select lang, {k}::int as ctx_order, n_symbols, n_contexts, bits from ({_conditional(f'(select lang, right(ctx, {k}) as ctx, c, n from g)', 'lang', 'ctx', 'c')})" for k in range(HIGHEST + 1)),
    "skip_contexts": _conditional(f"(select lang, left(ctx, 2) as ctx, c, 1 as n from {_grams(3, 'lang')})", "lang", "ctx", "c"),
    "char_group_contexts": _conditional(r"(select lang, regexp_replace(regexp_replace(regexp_replace(regexp_replace(ctx, '[a-z]+', 'a', 'g'), '[A-Z]+', 'A', 'g'), '[0-9]+', '0', 'g'), '[\x{80}-\x{10FFFF}]+', 'x', 'g') as ctx, c, n from " + f"(select lang, ctx, c, count(*) as n from {_grams(5, 'lang')} group by all))", "lang", "ctx", "c"),
    "chart_contexts": _conditional(f"(select left(a, 1) as initial, right(a, 2) as ending, b, n from ({_pairs(WORDS, 'documents')}))", "", "initial, ending", "b"),
    "word_contexts": _conditional(f"(select lang, p[1] as a, p[2] as b, 1 as n from (select lang, unnest(list_zip(w[1:len(w) - 1], w[2:])) as p from (select lang, {WORDS} as w from documents) where len(w) > 1))", "lang", "a", "b"),
    "text_contexts": f"with p as materialized (select a, left(b, 1) as c, sum(n) as n from ({_pairs(WORDS, 'documents')}) group by 1, 2) " + _conditional("(" + " union all ".join(f"select '{k}' as kind, {x} as ctx, c, n from p" for k, (_, x) in WORD_CONTEXTS.items()) + ")", "kind", "ctx", "c"),
    "context_history": f"select ctx, sum(n)::bigint as n_seen, count(*) as n_symbols, first(c order by n desc, c) as top from (select ctx, c, count(*) as n from {_grams(2, 'lang')} group by all) group by ctx",
    "next_bit_probabilities": "with h as (select lang, unnest(regexp_extract_all(hex(encode(text)), '..')) as h from documents), c as (select lang, ('0x' || h)::int as b, count(*) as n from h group by all) select lang, bit::int as bit, ((b + 256) >> (8 - bit))::int as ctx, sum(n)::bigint as n, sum(n * ((b >> (7 - bit)) & 1))::bigint as n1, round(sum(n * ((b >> (7 - bit)) & 1)) / sum(n), 6) as p1 from c, range(8) t(bit) group by 1, 2, 3",
    "laplace_bit_prob": "select quality, count(toxic) as n, sum(toxic)::bigint as n1, round((2 * sum(toxic) + 1) / (2 * count(toxic) + 2), 6) as p from labels group by 1",
    "event_type_markov": f"with {_EVENTS} select last2, last1, event_type, count(*) as n from (select event_type, lag(event_type, 1) over w as last1, lag(event_type, 2) over w as last2 from e window w as (partition by user_id order by event_id)) group by all",
    "event_run_lengths": f"with {_EVENTS}, m as (select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as run from e) select event_type, length, count(*) as n from (select user_id, event_type, run, count(*) as length from m group by all) group by all",
    "indirect_history": f"with {_EVENTS}, c as (select *, lag(event_type) over (partition by user_id order by event_id) as ctx from e) select ctx, h2, h1, event_type, count(*) as n from (select ctx, lag(event_type, 1) over w as h1, lag(event_type, 2) over w as h2, event_type from c where ctx is not null window w as (partition by user_id, ctx order by event_id)) group by all",
    "bit_history_states": f"with {_EVENTS}, h as (select y, coalesce(sum(y) over w, 0) as n1, coalesce(sum(1 - y) over w, 0) as n0 from e window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)) select least(7, n0)::bigint as n0, least(7, h.n1)::bigint as n1, count(y) as n, round((2 * sum(y) + 1) / (2 * count(y) + 2), 6) as p from h group by 1, 2",
    "running_mean_error": f"with {_EVENTS}, h as (select event_type, y, (2 * coalesce(sum(y) over w, 0) + 1) / (2 * count(*) over w + 2) as p from e window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)) select event_type, count(*) as n_events, round(avg(-log2(case y when 1 then p else 1 - p end)), 6) as bits from h group by 1",
    "loss_history": f"with {_EVENTS}, p as (select event_type, -log2(count(*) / (select count(*) from e)) as bits from e group by 1) select user_id, round(max(loss), 6) as max_loss, count(*) as n from (select user_id, avg(bits) over (partition by user_id order by event_id rows between 7 preceding and current row) as loss from e join p using (event_type)) group by 1",
    "fast_slow_estimates": f"with {_EVENTS}, r as (select user_id, y, row_number() over (partition by user_id order by event_id desc) - 1 as age from e) select user_id, count(*) as n, round(sum(y / 64.0::double * pow(1 - 1 / 64.0::double, age)), 6) as slow, round(sum(y / 16.0::double * pow(1 - 1 / 16.0::double, age)), 6) as fast from r group by 1",
    "residual_histogram": "with r as (select l_returnflag, l_quantity - (2 * lag(l_quantity, 1) over w - lag(l_quantity, 2) over w) as r from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)), b as (select l_returnflag, floor(r / 10)::bigint as bin, count(*) as n from r where r is not null group by 1, 2) select *, round(sum(n) over (partition by l_returnflag order by bin) / sum(n) over (partition by l_returnflag), 6) as cdf from b",
    "column_extrapolation": " union all ".join(f"select '{c}' as name, round(avg(abs({c} - n1)), 4) as order1, round(avg(abs({c} - 2 * n1 + n2)), 4) as order2, round(avg(abs({c} - 3 * n1 + 3 * n2 - n3)), 4) as order3, count(n3) as n from (select {c}, lag({c}, 1) over w as n1, lag({c}, 2) over w as n2, lag({c}, 3) over w as n3 from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice))" for c in ("l_quantity", "l_extendedprice")),
    "sliding_histogram": "select lang, round(avg(seen), 6) as mean_seen, max(seen) as max_seen from (select lang, count(*) over (partition by doc_id, c order by i range between 256 preceding and 1 preceding) as seen from (select doc_id, lang, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from documents where text != '')) group by 1",
    "calibration_bins": f"with {_P} select quality, floor({_STRETCH} * 2)::bigint as bin, count(*) as n, round(avg(toxic), 6) as p from x group by 1, 2",
    "interpolated_calibration": f"with {_P}, z as (select quality, toxic, ({_STRETCH} + 8) * (23 / 16) as z from x), r as (select quality, toxic, floor(z)::bigint as low, z - floor(z) as part from z), n as (select node, (sum(w * toxic) + 0.5) / (sum(w) + 1) as p from (select low as node, 1 - part as w, toxic from r union all select low + 1, part, toxic from r) group by 1) select quality, count(*) as n, round(avg(-log2(case toxic when 1 then q else 1 - q end)), 6) as bits from (select quality, toxic, a.p * (1 - part) + b.p * part as q from r join n a on a.node = low join n b on b.node = low + 1) group by 1",
    "linear_fit_by_user": "select user_id, count(*) as n, round(regr_slope(value, event_id::double), 6) as slope, round(regr_r2(value, event_id::double), 6) as r2 from events group by 1",
    "archive_totals": "select source, lang, count(*) as n_blocks, sum(strlen(text))::bigint as bytes, sum(greatest(1, ceil(length(bin(strlen(text))) / 7)))::bigint as header_bytes from documents group by rollup (source, lang)",
    "archive_catalog": "select doc_id, source, strlen(text)::bigint as length, case when contains(text, chr(13) || chr(10)) and not regexp_matches(text, '(?:^|[^\\r])\\n') then 'TEXT_EOL' else 'TEXT' end as type, coalesce(sum(strlen(text)) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from documents",
    "scalar_maths": f"select greatest(0, {_BITS} - 1)::int as ilog2, greatest(1, ceil(length(bin(k * 1000)) / 7))::int as vli, (32 - {_BITS})::int as clz, count(*) as n, sum(case when k <= 0 then 0 else round(log2(k) * 16) end)::bigint as llog, sum(bit_count(k))::bigint as ones, sum(least(abs(k % 256 - k * 7 % 256), 256 - abs(k % 256 - k * 7 % 256)))::bigint as dist, sum(case when abs(b - c) <= abs(a - c) and abs(b - c) <= abs(a + b - 2 * c) then a when abs(a - c) <= abs(a + b - 2 * c) then b else c end)::bigint as paeth, round(sum(round(greatest(-8, least(8, ln(v / 51 / (1 - v / 51)))), 6)), 3) as logit, round(sum(round(1 / (1 + exp(-(v - 25) / 10)), 6)), 3) as p from (select l_orderkey as k, l_quantity as v, l_orderkey % 256 as a, l_orderkey * 7 % 256 as b, l_orderkey * 13 % 256 as c from lineitem) group by 1, 2, 3",
    "last_match_kgram": f"select lang, {_AGG} from {_matches('text', K)} group by 1",
    "match_runs": f"""with m as (select *, pos - prev as gap from {_matches('text', K)} where prev is not null), n as (select *, case when pos - lag(pos) over (partition by doc_id, gap order by pos) <= 2 then 0 else 1 end as new from m),
r as (select doc_id, gap, min(pos) as start, max(pos) - min(pos) + {K} as length from (select *, sum(new) over (partition by doc_id, gap order by pos) as run from n) group by doc_id, gap, run)
select doc_id, count(*) as n_runs, first(length order by length desc, gap, start)::int as length, first(gap order by length desc, gap, start)::int as gap, first(start order by length desc, gap, start)::int as start from r group by 1""",
    "masked_matches": " union all ".join(f"select '{name}' as kind, {_AGG} from {_matches(text, k, stride)}" for name, text, k, stride in (("folded", FOLD, 5, 1), ("plain", "text", 4, 1), ("stride2", FOLD, 5, 2), ("classes", f"regexp_replace(regexp_replace({FOLD}, '[a-z]', 'a', 'g'), '[0-9]', '0', 'g')", 12, 1))),
    "lag_similarity_best": """
with c as (select doc_id, list_transform(string_split(text, ''), lambda x: unicode(x) % 256) as c from documents where text != ''),
s as (select doc_id, d, list_avg(list_transform(list_zip(c[d + 1:], c[1:len(c) - d]), lambda p: least(abs(p[1] - p[2]), 256 - abs(p[1] - p[2])))) as a from c, range(1, 33) t(d) where len(c) > d)
select doc_id, arg_min(d, (round(a, 6), d))::int as lag, min(round(a, 6)) as distance from s group by 1""",
    "record_period_vote": f"""
with r as (select l_orderkey // {LINES} as file, string_agg(rec, '' order by l_orderkey, l_linenumber, rec) as content from (select *, lpad(l_orderkey::varchar, 10, ' ') || lpad(l_linenumber::varchar, 2, ' ') || lpad(l_partkey::varchar, 8, ' ') || lpad(l_quantity::int::varchar, 4, ' ') || l_returnflag || l_linestatus || chr(10) as rec from lineitem) group by 1),
u as (select file, unnest(string_split(content, '')) as c, generate_subscripts(string_split(content, ''), 1) as i from r),
g as (select {', '.join(f'i - lag(i, {k}) over w as b{k}' for k in range(1, 7))} from u window w as (partition by file, c order by i))
select b1::int as period, count(*) as votes from g where b1 > 1 and b2 = 2 * b1 and b3 = 3 * b1 and (b1 > 32 or b4 = 4 * b1) and (b1 > 10 or (b5 = 5 * b1 and b6 = 6 * b1)) group by 1 order by votes desc, period limit 5""",
    "first_difference": "select a.doc_id, (case when a.text = b.text then null else (select coalesce(min(i) - 1, least(length(a.text), length(b.text))) from (select unnest(range(1, least(length(a.text), length(b.text)) + 1)) as i, unnest(string_split(a.text, '')[1:least(length(a.text), length(b.text))]) as x, unnest(string_split(b.text, '')[1:least(length(a.text), length(b.text))]) as y) where x != y) end)::int as place from documents a join documents b on b.doc_id = a.doc_id + 1",
    "block_type_markov": r"select before3, before2, before1, type, count(*) as n from (select type, lag(type, 1) over w as before1, lag(type, 2) over w as before2, lag(type, 3) over w as before3 from (select page_id, unnest(k) as type, generate_subscripts(k, 1) as i from (select page_id, list_transform(regexp_extract_all(html, '(?s)<!--.*?-->|<(?:script|style).*?</(?:script|style)>|<[^>]*>|[^<]+'), lambda x: case when x like '<!--%' then 'comment' when regexp_matches(x, '(?i)^<(?:script|style)') then 'code' when x like '<%' then 'markup' else 'text' end) as k from pages)) window w as (partition by page_id order by i)) where before1 is not null group by all",
}
