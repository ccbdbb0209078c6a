"""Queries on stems and on the language that the stemmers' hits tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stems as T
from ..operators import counting as C
from .text_queries import docs

#: Word and stem, as the published sample vocabularies pair them.
GOLDEN = {
    "en": "consign consign consigned consign consignment consign consistency consist consistently consist consolations consol consolatory consolatori consolidating consolid consolingly consol consonant conson conspicuous conspicu conspiracy conspiraci conspirators conspir conspiring conspir constables constabl constancy constanc knackeries knackeri knavish knavish kneeling kneel knightly knight knitted knit knives knive skies sky dying die news news",
    "fr": "continua continu continuait continu continuation continu continuellement continuel continuerait continu continuité continu continuons continuon contorsions contors contournait contourn contraction contract contradictoire contradictoir contraindre contraindr maintenant mainten maintenue maintenu mairie mair maïs maï maîtresse maîtress majestueusement majestu majeure majeur maladie malad",
    "de": "aufeinander aufeinand aufeinanderfolgende aufeinanderfolg aufeinanderschlugen aufeinanderschlug aufenthaltes aufenthalt auferlegten auferlegt auferstanden auferstand auferstehung aufersteh aufessen aufess kategorien kategori kategorischen kategor katers kat katzen katz kätzchen katzch",
}


def golden() -> list[tuple[str, str, str]]:
    return [(lang, w[i], w[i + 1]) for lang, text in GOLDEN.items() for w in [text.split()] for i in range(0, len(w), 2)]


def stem_golden(spark: SparkSession, sf: str) -> DataFrame:
    """The stemmers on the published sample vocabularies."""
    rows = spark.createDataFrame([(lang, w) for lang, w, _ in golden()], "lang string, word string")
    stem = F.coalesce(*[F.when(F.col("lang") == k, T.stemmed(F.col("word"), k)["stem"]) for k in T.STEMMERS])
    return rows.select("lang", "word", stem.alias("stem"))


def stem_counts(spark: SparkSession, sf: str) -> DataFrame:
    """By document language and stemmer: words, different stems, and words that the stemmer recognises. Each different word is stemmed once."""
    n = C.word_counts(docs(spark, sf, "lang", "text"), ["lang"], "text")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("stemmer"), T.stemmed(F.col("word"), k).alias("s")) for k in T.STEMMERS]))
    rows = n.select("lang", "n", each.alias("e")).groupBy("lang", "e.stemmer", "e.s.stem").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("e.s.recognised"), F.col("n")).otherwise(0)).alias("known"))
    return rows.groupBy("lang", "stemmer").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_stems"), F.sum("known").alias("n_recognised"))


def language_rule(spark: SparkSession, sf: str) -> DataFrame:
    """By document language: after how many words the rule of the last 64 words told which language."""
    rows = docs(spark, sf, "lang", "text").select("lang", F.explode(T.language_words(F.col("text"))).alias("told", "n"))
    return rows.groupBy("lang", "told").agg(F.sum("n").alias("n_words"))


QUERIES = {f.__name__: f for f in (stem_golden, stem_counts, language_rule)}
SQL = {"stem_golden": f"select * from (values {', '.join(str(row) for row in golden())}) t(lang, word, stem)"}
