"""Queries on words, sentences, numbers, shapes and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as T
from ..operators import counting as C
from ..operators import entropy as E
from ..sources.tables import table

#: Parts of the SQL twins.
FOLD = f"translate(text, '{T.UPPER}', '{T.LOWER}')"
WORD_SQL = T.WORD.replace("'", "''")
WORDS = f"regexp_extract_all({FOLD}, '{WORD_SQL}')"


def docs(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Columns of the documents. Python gets their texts in batches of bounded bytes."""
    C.bounded_batches(spark)
    return table(spark, sf, "documents").select(*cols)


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = C.word_counts(docs(spark, sf, "lang", "text"), ["lang"], "text")
    return n.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_words"), F.sum(F.col("n") * F.length("word")).alias("n_letters"))


def token_len_hist(spark: SparkSession, sf: str) -> DataFrame:
    n = E.symbol_counts(docs(spark, sf, "lang", "text"), ["lang"], F.transform(T.words(F.col("text")), F.length), "word_length")
    return n.select("lang", "word_length", "n")


def word_bigrams_topk(spark: SparkSession, sf: str) -> DataFrame:
    return C.pair_counts(docs(spark, sf, "text"), [], "text").orderBy(F.desc("n"), "a", "b").limit(20)


def alnum_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select(T.tokens(F.col("html")).alias("t"))
    return E.symbol_counts(rows, [], F.transform("t", lambda x: F.concat(F.when(x.rlike("[0-9]"), "digits").otherwise("letters"), F.lit("-"), F.length(x).cast("string"))), "kind")


def keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.symbol_counts(table(spark, sf, "pages").select("html"), [], T.keywords(F.col("html")), "keyword")


def topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    both = docs(spark, sf, "text").unionByName(table(spark, sf, "pages").select(F.col("html").alias("text")))
    return E.symbol_counts(both, [], T.topics(F.col("text")), "topic")


def expression_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Words in each expression; four or more are one class."""
    size = F.transform(T.expressions(F.col("text")), lambda e: F.least(F.lit(4), F.regexp_count(e, F.lit(T.PURE))))
    return E.symbol_counts(docs(spark, sf, "lang", "text"), ["lang"], size, "n_words")


def word_history(spark: SparkSession, sf: str) -> DataFrame:
    """The word before the last one, by the last: how many pairs, by the lengths of both (shifts of the word history)."""
    w = T.words(F.col("text"))
    two = F.transform(T.pairs(w), lambda p: F.struct(F.least(F.length(p["a"]), F.lit(9)).alias("len1"), F.least(F.length(p["b"]), F.lit(9)).alias("len0")))
    return docs(spark, sf, "text").select(F.explode(two).alias("p")).groupBy("p.len1", "p.len0").agg(F.count("*").alias("n"))


def sentence_types(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    rows = docs(spark, sf, "lang", "text").select("lang", (T.count_of(t, r"\.") - T.abbreviated(t, F.col("lang"))).alias("d"), T.count_of(t, r"\?").alias("i"), T.count_of(t, "!").alias("x"), T.count_of(t, "[,;:]").alias("c"))
    s = F.sum
    return rows.groupBy("lang").agg(s("d").alias("declarative"), s("i").alias("interrogative"), s("x").alias("exclamative"), s(F.col("d") + F.col("i") + F.col("x") + F.col("c")).alias("clauses"))


def paragraph_counts(spark: SparkSession, sf: str) -> DataFrame:
    """On texts whose sentences are set apart by an empty line, in odd documents with CRLF: each LF right after a line end is a boundary."""
    t = F.replace(F.col("text"), F.lit(". "), F.when(F.col("doc_id") % 2 == 1, F.lit(".\r\n\r\n")).otherwise(F.lit(".\n\n")))
    rows = docs(spark, sf, "doc_id", "lang", "text").select("lang", t.alias("t"))
    extra = lambda p, size: F.aggregate(F.transform(T.extract(F.col("t"), p), lambda x: F.length(x) / size - 1), F.lit(0.0), lambda a, b: a + b)
    lf = extra(r"\n\n+", 1) + extra(r"(?:\r\n){2,}", 2)
    return rows.groupBy("lang").agg(F.sum(lf).cast("bigint").alias("boundaries"))


def number_sequence_codes(spark: SparkSession, sf: str) -> DataFrame:
    both = docs(spark, sf, "text").unionByName(table(spark, sf, "pages").select(F.col("html").alias("text"))).select(T.numbers(F.col("text")).alias("x"))
    code = F.transform("x", lambda v, i: F.struct(v.alias("now"), F.coalesce(F.get(F.col("x"), i - 1), F.lit(0)).alias("was")))
    rows = both.select(F.explode(code).alias("p")).select("p.now", "p.was")
    rows = rows.select((1 + (F.col("now") >= F.col("was")).cast("int") + (F.col("now") > F.col("was")).cast("int")).alias("code"), F.least(F.lit(3), M.ilog2(F.abs(F.col("now") - F.col("was")))).alias("log_diff"))
    return rows.groupBy("code", "log_diff").agg(F.count("*").alias("n"))


def expected_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers told by the two before: one more, the same or one less, as these rise, stay or fall; whole, and all digits but the last."""
    both = docs(spark, sf, "text").unionByName(table(spark, sf, "pages").select(F.col("html").alias("text"))).select(T.numbers(F.col("text")).alias("x"))
    three = F.transform("x", lambda v, i: F.struct(*[F.when(i >= k, F.get("x", i - k)).alias(f"x{k}") for k in (0, 1, 2)]))
    rows = both.select(F.inline(three)).where("x2 is not null")
    rows = rows.select(F.col("x0").cast("string").alias("now"), F.signum(F.col("x1") - F.col("x2")).cast("int").alias("step"), "x1")
    rows = rows.withColumn("told", (F.col("x1") + F.col("step")).cast("string"))
    head = lambda c: F.expr(f"left({c}, length({c}) - 1)")
    near = (F.length("now") == F.length("told")) & (F.length("now") > 1) & (head("now") == head("told"))
    return rows.groupBy("step").agg(F.count("*").alias("n"), F.sum((F.col("now") == F.col("told")).cast("bigint")).alias("n_told"), F.sum(near.cast("bigint")).alias("n_but_last"))


def char_shape_topk(spark: SparkSession, sf: str) -> DataFrame:
    urls = table(spark, sf, "pages").select(F.col("url").alias("v"))
    names = table(spark, sf, "customer").select(F.col("c_name").alias("v")).unionByName(table(spark, sf, "part").select(F.col("p_name").alias("v"))).unionByName(urls)
    return names.groupBy(T.shape(F.col("v")).alias("shape")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(20)


BRACKETS = r"[()\[\]{}<>]"


def nesting_depth_max(spark: SparkSession, sf: str) -> DataFrame:
    step = lambda s, b: F.struct((s["d"] + F.when(b.isin("(", "[", "{", "<"), 1).otherwise(-1)).alias("d"), F.greatest(s["m"], s["d"] + F.when(b.isin("(", "[", "{", "<"), 1).otherwise(-1)).alias("m"))
    deep = F.aggregate(T.extract(F.col("html"), BRACKETS), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step)
    return table(spark, sf, "pages").select("page_id", deep["m"].alias("depth"), deep["d"].alias("last_depth"))


def nest_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """What bracket follows which: counts of pairs."""
    rows = table(spark, sf, "pages").select(F.explode(T.pairs(T.extract(F.col("html"), BRACKETS))).alias("p"))
    return rows.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


LITERALS = ["2024-01-31", "31.12.2023", "1-2-2024", " 12:30", "at 12:30:59", "http://a.b/c", "47°36'", "it is 21°C", "see ISBN 3", "plain text here", "5", "", "99°G"]


def content_type_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of what stands between tags and in quoted attributes of the pages, and of literals."""
    html = F.col("html")
    cells = F.concat(T.extract(html, ">([^<]+)<", 1), T.extract(html, '="([^"]*)"', 1))
    rows = table(spark, sf, "pages").select(F.explode(cells).alias("v")).unionByName(spark.createDataFrame([(x,) for x in LITERALS], "v string"))
    return rows.groupBy(T.content_flags(F.col("v")).alias("flags")).agg(F.count("*").alias("n"))


def html_tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.transform(T.extract(F.col("html"), r"</?[A-Za-z][A-Za-z0-9]*"), lambda x: T.fold(x))
    rows = E.symbol_counts(table(spark, sf, "pages").select("html"), [], tags, "tag")
    return rows.groupBy(F.regexp_replace("tag", "[</]", "").alias("tag")).agg(F.sum(F.when(~F.col("tag").startswith("</"), F.col("n")).otherwise(0)).alias("opened"), F.sum(F.when(F.col("tag").startswith("</"), F.col("n")).otherwise(0)).alias("closed"))


def html_tag_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Levels, comments, attributes and empty tags of a page, by one pass over its tags."""
    tags = table(spark, sf, "pages").select("page_id", T.extract(F.col("html"), T.TAG).alias("t"))
    kind = lambda x: F.when(x.startswith("<!--"), "comment").when(x.startswith("<!["), "cdata").when(x.startswith("</"), "end").when(x.endswith("/>") | x.rlike(VOID), "empty").otherwise("start")
    rows = tags.select("page_id", "t", F.transform("t", kind).alias("k"))
    count = lambda what: F.size(F.filter("k", lambda x: x == what)).alias(f"n_{what}")
    step = lambda s, x: F.struct((s["d"] + F.when(x == "start", 1).when(x == "end", -1).otherwise(0)).alias("d"), F.greatest(s["m"], s["d"] + F.when(x == "start", 1).otherwise(0)).alias("m"))
    level = F.aggregate("k", F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step)["m"]
    attrs = F.aggregate(F.transform("t", lambda x: F.when(x.rlike("^<[A-Za-z]"), F.regexp_count(x, F.lit(ATTR))).otherwise(0)), F.lit(0), lambda a, b: a + b)
    return rows.select("page_id", F.size("k").alias("n_tags"), *[count(x) for x in ("start", "end", "empty", "comment", "cdata")], level.alias("max_level"), attrs.alias("n_attributes"))


#: Tags that have no end.
VOID = r"(?i)^<(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b"
ATTR = r"[A-Za-z_:][A-Za-z0-9_:.\-]*="


def indentation_hist(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x: F.length(F.regexp_extract(x, "^[ \t]*", 0)))
    return E.symbol_counts(docs(spark, sf, "text"), [], lines, "indent")


def line_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a document, its largest column, and how many lines begin with a capital."""
    rows = docs(spark, sf, "doc_id", "text").select("doc_id", F.split("text", "\n").alias("l"))
    return rows.select("doc_id", F.size("l").alias("n_lines"), F.array_max(F.transform("l", F.length)).alias("max_column"), F.size(F.filter("l", lambda x: x.rlike("^[A-Z]"))).alias("n_capital"))


def since_event(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance to the last capital, digit and line end, over the places after a first one: gaps of length g hold 0..g-1."""
    t = F.col("text")

    def mean(pattern: str, name: str) -> list:
        gaps = lambda: F.transform(F.slice(F.split(t, pattern, -1), F.lit(2), F.size(F.split(t, pattern, -1))), lambda x: F.length(x) + 1)
        total = F.aggregate(gaps(), F.lit(0).cast("bigint"), lambda a, g: a + (g.cast("bigint") * (g.cast("bigint") - 1) / 2).cast("bigint"))
        n = F.aggregate(gaps(), F.lit(0).cast("bigint"), lambda a, g: a + g)
        return [F.round(F.sum(total) / F.sum(n), 6).alias(f"since_{name}")]

    return docs(spark, sf, "lang", "text").groupBy("lang").agg(*mean("[A-Z]", "capital"), *mean("[0-9]", "digit"), *mean("\n", "line"))


def vowel_classes(spark: SparkSession, sf: str) -> DataFrame:
    t = T.fold(F.col("text"))
    return docs(spark, sf, "lang", "text").groupBy("lang").agg(F.sum(T.count_of(t, "[aeiou]")).alias("n_vowels"), F.sum(T.count_of(t, "[b-df-hj-np-tv-z]")).alias("n_consonants"), F.sum(T.count_of(t, r"[^\x{0}-\x{7F}]")).alias("n_other"))


def quote_lengths(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.transform(T.extract(F.col("html"), '"([^"]*)"', 1), lambda q: F.least(F.lit(8), F.size(T.words(q))))
    return E.symbol_counts(table(spark, sf, "pages").select("html"), [], rows, "n_words")


def hyphenation_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Texts broken with + at line ends inside words, joined again."""
    broken = F.regexp_replace("text", "([a-z])th([a-z])", "$1t+\nh$2")
    joined = F.regexp_replace(broken, r"([a-z])\+\r?\n", "$1")
    return docs(spark, sf, "lang", "text").groupBy("lang").agg(F.sum(F.length(broken)).alias("chars_broken"), F.sum(F.length(joined)).alias("chars_joined"), F.sum((joined == F.col("text")).cast("bigint")).alias("n_equal"))


def utf8_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of the texts, whole and cut by one byte: a cut inside a character leaves no valid UTF-8."""
    whole = F.encode(F.col("text"), "UTF-8")
    cut = F.substring(whole, 1, F.octet_length("text") - 1)
    rows = docs(spark, sf, "lang", "text").where("text != ''")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"), F.sum(F.is_valid_utf8(whole.cast("string")).cast("bigint")).alias("n_valid"), F.sum(F.is_valid_utf8(cut.cast("string")).cast("bigint")).alias("n_valid_cut"))


def affix_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a language that are longer than a suffix or prefix they have."""
    n = C.word_counts(docs(spark, sf, "lang", "text"), ["lang"], "text")
    parts = {"end_ing": T.ends_within(F.col("word"), "ing"), "end_ion": T.ends_within(F.col("word"), "ion"), "start_th": T.starts_within(F.col("word"), "th")}
    return n.groupBy("lang").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in parts.items()])


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark with three bytes each: length, first and last letter."""
    w = table(spark, sf, "benchmark").select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).distinct()
    byte = lambda c: F.pmod(F.ascii(c), F.lit(256))
    return w.select("word", F.array(F.pmod(F.length("word"), F.lit(256)), byte(F.left("word", F.lit(1))), byte(F.right("word", F.lit(1)))).alias("e"))


def embedding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Words are counted first, so each is looked up once; how the join runs is left to the optimizer, by size."""
    n = C.word_counts(docs(spark, sf, "lang", "text"), ["lang"], "text")
    rows = n.join(dictionary(spark, sf), "word", "left")
    return rows.groupBy("lang").agg(F.sum(F.when(F.col("e").isNotNull(), F.col("n")).otherwise(0)).alias("n_found"), F.sum(F.when(F.col("e").isNull(), F.col("n")).otherwise(0)).alias("n_missing"), F.sum(F.coalesce(F.get("e", F.lit(1)), F.lit(0)) * F.col("n")).alias("sum_first"))


def embedding_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Word bigrams by the distance of their vectors (whole root), with sums of the vectors' first bytes modulo 256."""
    pairs = C.pair_counts(docs(spark, sf, "text"), [], "text")
    d = dictionary(spark, sf)
    rows = pairs.join(d.select(F.col("word").alias("a"), F.col("e").alias("ea")), "a").join(d.select(F.col("word").alias("b"), F.col("e").alias("eb")), "b")
    square = F.aggregate(F.zip_with("ea", "eb", lambda x, y: (x - y) * (x - y)), F.lit(0), lambda s, x: s + x)
    plus = F.pmod(F.get("ea", F.lit(1)) + F.get("eb", F.lit(1)), F.lit(256))
    return rows.groupBy(F.floor(F.sqrt(square)).cast("bigint").alias("distance")).agg(F.sum("n").alias("n"), F.sum(plus * F.col("n")).alias("sum_plus"))


def vector_distance_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector against that of the id before: an equi-join, no global order."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    before = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("was"))
    square = F.aggregate(F.zip_with("embedding", "was", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return v.join(before, "vec_id").select("vec_id", F.round(F.sqrt(square), 5).alias("distance"))


QUERIES = {f.__name__: f for f in (token_counts, token_len_hist, word_bigrams_topk, alnum_tokens, keyword_counts, topic_counts, expression_lengths, word_history, sentence_types, paragraph_counts, number_sequence_codes, expected_numbers, char_shape_topk, nesting_depth_max, nest_contexts, content_type_flags, html_tag_counts, html_tag_tree, indentation_hist, line_stats, since_event, vowel_classes, quote_lengths, hyphenation_joined, utf8_validity, affix_counts, embedding_lookup, embedding_pairs, vector_distance_consecutive)}

_FLAGS = " + ".join(f"case when regexp_matches(v, '{p.replace(chr(39), chr(39) * 2)}') then {1 << k} else 0 end" for k, (_, p) in enumerate(T.CONTENT))


def _pairs(words: str, source: str) -> str:
    return f"select p[1] as a, p[2] as b, count(*) as n from (select unnest(list_zip(w[1:len(w) - 1], w[2:])) as p from (select {words} as w from {source}) where len(w) > 1) group by 1, 2"


def _abbreviated() -> str:
    case = " ".join(f"when '{k}' then len(regexp_extract_all(text, '(?:^|[^A-Za-z''\\-\\x{{80}}-\\x{{10FFFF}}])(?:{'|'.join(w.capitalize() for w in v)})\\.'))" for k, v in T.ABBREVIATIONS.items())
    return f"(case lang {case} else 0 end)"


def _count(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _since(pattern: str, name: str) -> str:
    gaps = f"list_transform(string_split_regex(text, '{pattern}')[2:], lambda x: length(x) + 1)"
    return f"round(sum(coalesce(list_sum(list_transform({gaps}, lambda g: g * (g - 1) // 2)), 0)) / sum(coalesce(list_sum({gaps}), 0)), 6) as since_{name}"


_DICT = f"dict as (select word, [length(word) % 256, unicode(word[1]) % 256, unicode(word[-1]) % 256] as e from (select distinct unnest({WORDS}) as word from benchmark))"
_WORD_COUNTS = f"w as (select lang, word, count(*) as n from (select lang, unnest({WORDS}) as word from documents) group by all)"

SQL = {
    "token_counts": f"with {_WORD_COUNTS} select lang, sum(n)::bigint as n_tokens, count(*) as n_words, sum(n * length(word))::bigint as n_letters from w group by lang",
    "token_len_hist": f"select lang, length(word)::int as word_length, count(*) as n from (select lang, unnest({WORDS}) as word from documents) group by all",
    "word_bigrams_topk": f"select * from ({_pairs(WORDS, 'documents')}) order by n desc, a, b limit 20",
    "alnum_tokens": f"select case when regexp_matches(t, '[0-9]') then 'digits' else 'letters' end || '-' || length(t) as kind, count(*) as n from (select unnest(regexp_extract_all(regexp_replace({FOLD.replace('text', 'html')}, '([0-9])\\.', '\\1' || chr(1), 'g'), '{T.TOKEN}')) as t from pages) group by 1",
    "keyword_counts": f"select replace(keyword, chr(1), '.') as keyword, count(*) as n from (select unnest(regexp_extract_all(regexp_replace({FOLD.replace('text', 'html')}, '([0-9])\\.', '\\1' || chr(1), 'g'), '({T.TOKEN})[:=]', 1)) as keyword from pages) group by 1",
    "topic_counts": f"select topic, count(*) as n from (select unnest(regexp_extract_all({FOLD}, '({WORD_SQL})[^a-z''\\-:\\x{{80}}-\\x{{10FFFF}}]*:', 1)) as topic from (select text from documents union all select html from pages)) group by 1",
    "expression_lengths": f"select lang, least(4, len(regexp_extract_all(e, '{T.PURE}')))::int as n_words, count(*) as n from (select lang, unnest(regexp_extract_all({FOLD}, '[a-z \\t\\r\\n\\x{{80}}-\\x{{10FFFF}}]+')) as e from documents) where regexp_matches(e, '[^ \\t\\r\\n]') group by 1, 2",
    "word_history": f"select least(length(a), 9)::int as len1, least(length(b), 9)::int as len0, sum(n)::bigint as n from ({_pairs(WORDS, 'documents')}) group by 1, 2",
    "sentence_types": f"select lang, sum(d)::bigint as declarative, sum(i)::bigint as interrogative, sum(x)::bigint as exclamative, sum(d + i + x + c)::bigint as clauses from (select lang, {_count('[.]')} - {_abbreviated()} as d, {_count('[?]')} as i, {_count('!')} as x, {_count('[,;:]')} as c from documents) group by lang",
    "paragraph_counts": r"select lang, sum(coalesce(list_sum(list_transform(regexp_extract_all(t, '\n\n+'), lambda x: length(x) - 1)), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, '(?:\r\n){2,}'), lambda x: length(x) // 2 - 1)), 0))::bigint as boundaries from (select lang, replace(text, '. ', case when doc_id % 2 = 1 then '.' || chr(13) || chr(10) || chr(13) || chr(10) else '.' || chr(10) || chr(10) end) as t from documents) group by lang",
    "number_sequence_codes": """
with x as (select list_filter(list_transform(regexp_extract_all(text, '[0-9]+'), lambda d: right(d, 18)::bigint), lambda v: v > 0) as x from (select text from documents union all select html as text from pages)),
p as (select unnest(x) as now, unnest(list_prepend(0::bigint, x[1:len(x) - 1])) as was from x where len(x) > 0)
select (1 + (now >= was)::int + (now > was)::int)::int as code, least(3, case when now = was then 0 else length(bin(abs(now - was))) - 1 end)::int as log_diff, count(*) as n from p group by 1, 2""",
    "expected_numbers": """
with x as (select list_filter(list_transform(regexp_extract_all(text, '[0-9]+'), lambda d: right(d, 18)::bigint), lambda v: v > 0) as x from (select text from documents union all select html as text from pages)),
p as (select unnest(x[3:])::varchar as now, unnest(x[2:len(x) - 1]) as x1, unnest(x[1:len(x) - 2]) as x2 from x where len(x) > 2),
t as (select now, sign(x1 - x2)::int as step, (x1 + sign(x1 - x2)::bigint)::varchar as told from p)
select step, count(*) as n, sum((now = told)::int)::bigint as n_told, sum((length(now) = length(told) and length(now) > 1 and left(now, -1) = left(told, -1))::int)::bigint as n_but_last from t group by 1""",
    "char_shape_topk": r"select regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '[a-z]+', 'a', 'g'), '[A-Z]+', 'A', 'g'), '[0-9]+', '0', 'g'), '[\x{80}-\x{10FFFF}]+', 'x', 'g') as shape, count(*) as n from (select c_name as v from customer union all select p_name from part union all select url from pages) group by 1 order by n desc, shape limit 20",
    "nesting_depth_max": r"""
with b as (select page_id, regexp_extract_all(html, '[()\[\]{}<>]') as b from pages),
u as (select page_id, unnest(b) as c, generate_subscripts(b, 1) as i from b),
d as (select page_id, i, sum(case when c in ('(', '[', '{', '<') then 1 else -1 end) over (partition by page_id order by i) as d from u)
select b.page_id, greatest(0, coalesce(max(d), 0))::int as depth, coalesce(arg_max(d, i), 0)::int as last_depth from b left join d using (page_id) group by 1""",
    "nest_contexts": _pairs(r"regexp_extract_all(html, '[()\[\]{}<>]')", "pages"),
    "content_type_flags": f"select ({_FLAGS})::int as flags, count(*) as n from (select unnest(regexp_extract_all(html, '>([^<]+)<', 1)) as v from pages union all select unnest(regexp_extract_all(html, '=\"([^\"]*)\"', 1)) from pages union all select unnest([{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in LITERALS)}])) group by 1",
    "html_tag_counts": f"select regexp_replace(t, '[</]', '', 'g') as tag, sum((t not like '</%')::int)::bigint as opened, sum((t like '</%')::int)::bigint as closed from (select translate(unnest(regexp_extract_all(html, '</?[A-Za-z][A-Za-z0-9]*')), '{T.UPPER}', '{T.LOWER}') as t from pages) group by 1",
    "html_tag_tree": rf"""
with t as (select page_id, regexp_extract_all(html, '{T.TAG}') as t from pages),
u as (select page_id, unnest(t) as x, generate_subscripts(t, 1) as i from t),
k as (select *, case when x like '<!--%' then 'comment' when x like '<![%' then 'cdata' when x like '</%' then 'end' when x like '%/>' or regexp_matches(x, '{VOID}') then 'empty' else 'start' end as k from u),
d as (select *, sum(case k when 'start' then 1 when 'end' then -1 else 0 end) over (partition by page_id order by i) as d from k)
select page_id, count(*)::int as n_tags, sum((k = 'start')::int)::int as n_start, sum((k = 'end')::int)::int as n_end, sum((k = 'empty')::int)::int as n_empty, sum((k = 'comment')::int)::int as n_comment, sum((k = 'cdata')::int)::int as n_cdata,
greatest(0, max(d))::int as max_level, sum(case when regexp_matches(x, '^<[A-Za-z]') then len(regexp_extract_all(x, '{ATTR}')) else 0 end)::int as n_attributes from d group by page_id""",
    "indentation_hist": r"select length(regexp_extract(l, '^[ \t]*'))::int as indent, count(*) as n from (select unnest(string_split(text, chr(10))) as l from documents) group by 1",
    "line_stats": "select doc_id, len(l)::int as n_lines, list_max(list_transform(l, lambda x: length(x)))::int as max_column, len(list_filter(l, lambda x: regexp_matches(x, '^[A-Z]')))::int as n_capital from (select doc_id, string_split(text, chr(10)) as l from documents)",
    "since_event": f"select lang, {_since('[A-Z]', 'capital')}, {_since('[0-9]', 'digit')}, {_since(chr(92) + 'n', 'line')} from documents group by lang",
    "vowel_classes": f"select lang, sum({_count('[aeiou]', FOLD)})::bigint as n_vowels, sum({_count('[b-df-hj-np-tv-z]', FOLD)})::bigint as n_consonants, sum({_count(chr(91) + '^' + chr(92) + 'x{0}-' + chr(92) + 'x{7F}]', FOLD)})::bigint as n_other from documents group by lang",
    "quote_lengths": f"select least(8, len(regexp_extract_all({FOLD.replace('text', 'q')}, '{WORD_SQL}')))::int as n_words, count(*) as n from (select unnest(regexp_extract_all(html, '\"([^\"]*)\"', 1)) as q from pages) group by 1",
    "hyphenation_joined": r"select lang, sum(length(b))::bigint as chars_broken, sum(length(j))::bigint as chars_joined, sum((j = text)::int)::bigint as n_equal from (select *, regexp_replace(b, '([a-z])\+\r?\n', '\1', 'g') as j from (select lang, text, regexp_replace(text, '([a-z])th([a-z])', '\1t+' || chr(10) || 'h\2', 'g') as b from documents)) group by lang",
    "utf8_validity": "select lang, count(*) as n, sum(strlen(text))::bigint as bytes, count(*)::bigint as n_valid, sum((unicode(text[-1]) < 128)::int)::bigint as n_valid_cut from documents where text != '' group by lang",
    "affix_counts": f"with {_WORD_COUNTS} select lang, sum(case when word like '_%ing' then n else 0 end)::bigint as end_ing, sum(case when word like '_%ion' then n else 0 end)::bigint as end_ion, sum(case when word like 'th_%' then n else 0 end)::bigint as start_th from w group by lang",
    "embedding_lookup": f"with {_WORD_COUNTS}, {_DICT} select lang, sum(case when e is not null then n else 0 end)::bigint as n_found, sum(case when e is null then n else 0 end)::bigint as n_missing, sum(coalesce(e[2], 0) * n)::bigint as sum_first from w left join dict using (word) group by lang",
    "embedding_pairs": f"with p as ({_pairs(WORDS, 'documents')}), {_DICT} select floor(sqrt((x.e[1] - y.e[1]) ** 2 + (x.e[2] - y.e[2]) ** 2 + (x.e[3] - y.e[3]) ** 2))::bigint as distance, sum(n)::bigint as n, sum((x.e[2] + y.e[2]) % 256 * n)::bigint as sum_plus from p join dict x on x.word = a join dict y on y.word = b group by 1",
    "vector_distance_consecutive": "select v.vec_id, round(sqrt(list_sum(list_transform(list_zip(v.embedding, w.embedding), lambda p: (p[1]::double - p[2]::double) ** 2))), 5) as distance from embeddings v join embeddings w on w.vec_id = v.vec_id - 1",
}
