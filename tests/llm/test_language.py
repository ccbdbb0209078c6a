import math
import zlib

from loamspark.llm import language

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = language.op10_language(spark, SMALL).collect()
    assert len(out) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held)
    assert right > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_mixture(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs)
    pure = {l: " ".join(r["text"] for r in docs.where(f"lang = '{l}'").limit(30).collect())[:4000] for l in ("en", "de")}
    got = model.predict([pure["en"], pure["de"], pure["en"] + " " + pure["de"][:2000], None, "", "123 !?", "a"])
    assert [g["lang"] for g in got[:2]] == ["en", "de"]
    assert set(got[2]["langs"]) == {"en", "de"} and got[2]["lang"] == "en"
    assert abs(sum(got[2]["shares"]) - 1) < 0.1
    assert [(g["lang"], g["score"]) for g in got[3:6]] == [("und", 0.0)] * 3
    assert got[6]["lang"] in model.langs


def test_labels_of_held_out_documents_are_not_learned(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    from pyspark.sql import functions as F

    lied = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in language.train(lied).langs


def test_awkward_and_empty(spark, awkward, no_docs):
    model = language.train(awkward)
    rows = awkward.select("doc_id", "text", language.identified(awkward["text"], model).alias("x")).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["x"]["lang"] == "und") == (not letters)
    kept = language.drop_unidentified(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == sum(any(c.isalpha() for c in r["text"] or "") for r in rows)
    assert language.train(no_docs).langs == [] and language.drop_unidentified(no_docs).collect() == []
    untaught = language.Model([], language.np.zeros((0, language.BUCKETS)))
    assert untaught.predict(["hello"])[0]["lang"] == "und"


def slow(model, text):
    """One document by plain loops: word likelihoods, mixtures of each set of the largest languages, each fitted anew."""
    raw = b" " + language._bytes(text) + b" "
    words = []
    for w in raw.split(b" "):
        if w:
            bucket, _ = language._grams(b" " + w + b" ")
            lls = [math.fsum(float(x) for x in log[bucket]) for log in model.logs]
            words.append([math.exp(x - max(lls)) * (1 - language.FLOOR) + language.FLOOR for x in lls])

    def em(pi, rounds):
        for _ in range(rounds):
            new = [0.0] * len(pi)
            for q in words:
                total = sum(a * p for a, p in zip(q, pi, strict=True))
                for k, (a, p) in enumerate(zip(q, pi, strict=True)):
                    new[k] += a * p / total / len(words)
            pi = new
        return pi, sum(math.log(sum(a * p for a, p in zip(q, pi, strict=True))) for q in words)

    m = len(model.langs)
    full, _ = em([1 / m] * m, language.ROUNDS)
    order = sorted(range(m), key=lambda k: (-full[k], k))
    best = None
    for k in range(1, m + 1):
        pi = [full[j] + 1e-6 if j in order[:k] else 0.0 for j in range(m)]
        pi, ll = em([p / sum(pi) for p in pi], language.ROUNDS)
        value = ll - language.PENALTY * k * math.log(len(words) + 1)
        if best is not None and value <= best[0]:
            break
        best = value, {model.langs[j]: pi[j] for j in order[:k]}
    return best[1]


def test_equals_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 3000").limit(60)
    model = language.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    texts = [r["text"] for r in docs.collect()]
    texts = [t for t in texts if language.has_letter(t)]
    texts += [texts[0] + " " + texts[5], texts[3] + " " + texts[9] + " " + texts[11], "a", "\u00b2 \u00bd x"]
    for got, t in zip(model.predict(texts), texts, strict=True):
        want = slow(model, t)
        assert set(got["langs"]) == set(want)
        assert all(abs(want[x] - p) < 1e-3 for x, p in zip(got["langs"], got["shares"], strict=True))
        assert got["lang"] == got["langs"][0] and abs(got["score"] - max(want.values())) < 1e-3


def test_numerals_are_no_letters(spark):
    model = language.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert [r["lang"] for r in model.predict(["\u00b2 \u00bd", "\u2167\u2460 7", "_"])] == ["und"] * 3
    assert model.predict(["\u00aa"])[0]["lang"] != "und"


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGS", 2)
    assert len(language.train(spark.read.parquet(f"{SMALL}/documents.parquet")).langs) == 2
