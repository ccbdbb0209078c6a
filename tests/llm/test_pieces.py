import pyarrow as pa
import pytest
import sentencepiece
from loamspark.llm import pieces

SMALL = "/root/testdata/sf0.01"
ODD = ["", " ", "  two  spaces ", "▁", "a▁b", "\n\n\t", "日本語テキスト", "🙂🙂 \U0010ffff", "é́", "x" * 3000, "ab" * 40, "the " * 500, "\x00\x01", "<s></s><unk><0x41>", "Zürich, naïve ÀÉ 1234567890 ... !!!"]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model()


def test_equals_the_library(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert model.encode(texts).to_pylist() == library.encode(texts)
    assert model.decode(model.encode(texts)).to_pylist() == [t.replace("▁", " ") for t in texts]
    ids = [[1, 2, 0, 5], [31999, 3, 300, 290], [259], [230, 190, 70], []]
    assert model.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == library.decode(ids)


def test_long_texts_are_cut_where_words_begin(model, monkeypatch):
    monkeypatch.setattr(pieces, "PIECE", 50)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["  a  lot   of    spaces " * 30, "x" * 300, "one\ntwo three " * 40, " " * 200, "", "word " * 100 + " " * 90 + "end"]
    assert model.encode(texts).to_pylist() == library.encode(texts)


def test_query(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = pieces.op8_sentencepiece(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r["doc_id"]: r["ids"] for r in out} == {i: library.encode(t) for i, t in texts.items()}
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in out)


def test_unigram_viterbi_is_the_best_path():
    """Against all segmentations of short words."""
    m = pieces.Pieces.made([(" ", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -2.7), (" a", -2.2), ("ba", -4.0), ("aba", -3.9), (" ab", -6.0)], True)
    score = dict(zip(m.text[1:], m.score[1:], strict=True))

    def best(w):
        if not w:
            return 0.0, []
        out = (float("-inf"), [])
        for k in range(1, len(w) + 1):
            if w[:k] in score:
                s, path = best(w[k:])
                out = max(out, (score[w[:k]] + s, [m.id[w[:k]], *path]), key=lambda x: x[0])
        return out

    for w in ("a", "ab", "aba", "abab", "babba", "aabbaab"):
        assert m.encode([w]).to_pylist()[0] == best(" " + w)[1]


def test_hash_clash_is_caught(model):
    assert model.slow(model._normal("hello world again")) == model.encode(["hello world again"]).to_pylist()[0]


def test_awkward_and_empty(spark, awkward, no_docs, model):
    out = pieces.tokenized(awkward).collect()
    assert len(out) == awkward.count()
    for r in out:
        assert (r["ids"] is None) == (r["exact"] is None)
        assert r["n_tokens"] == len(r["ids"] or []) and r["exact"] is not False
    assert pieces.tokenized(no_docs).collect() == []
    back = awkward.select("text", pieces.decode(pieces.encode(awkward["text"], model), model).alias("b")).collect()
    assert all(r["b"] == (r["text"].replace("▁", " ") if r["text"] is not None else None) for r in back)
