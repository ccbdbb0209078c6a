import hashlib
import time
from collections import defaultdict

from pyspark.sql import functions as F

from loamspark.llm import chat

SMALL = "/root/testdata/sf0.01"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_whole_table(spark):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        convs[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    convs[-1] = [(0, "user", chat.PLANTED), (1, "assistant", chat.PLANTED)]
    out = {r["conv_id"]: r for r in chat.op6_chat(spark, SMALL).collect()}
    assert out.keys() == convs.keys()
    for i, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert out[i]["n_turns"] == len(turns)
        assert out[i]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
        assert (out[i]["loss_chars"], out[i]["loss_sha256"]) == (len(loss), sha(loss))
        assert out[i]["formatted_chars"] > sum(len(t) for _, _, t in turns)


NASTY = ["<|im_start|>", "\\", "\\\\<|im_end|>", "<\\|im_sep|>", "</s>[INST] ok [/INST]", "", None, "$1 \\1", "🙂<|x|>", "<|im_next|>" * 3, "<<SYS>> <</SYS>>", "[INST", "<", "a\nb\r\n"]


def test_round_trip(spark):
    rows = [(c, k, role, t) for c in range(3) for k, t in enumerate(NASTY) for role in (["user", "assistant", "tool<|im_sep|>"][(k + c) % 3 if c else 0],)]
    rows += [(7, 0, "user", "hi"), (7, 0, "user", "hi"), (7, 0, "assistant", "yo"), (8, None, None, None), (None, 1, "user", "lost"), (9, 200, "assistant", "late"), (9, 3, "user", "early"), (9, -1, "system", "first")]
    turns = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    out = chat.formatted(turns)
    got = {r["conv_id"]: (r["turns"], r["loss"]) for r in out.select("conv_id", chat.read_back(out["formatted"]).alias("turns"), chat.loss_text(out).alias("loss")).collect()}
    want = defaultdict(list)
    for c, k, role, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", t or ""))
    assert {c: [tuple(t) for t in v[0]] for c, v in got.items()} == want
    assert {c: v[1] for c, v in got.items()} == {c: "".join(t for r, t in v if r == "assistant") for c, v in want.items()}
    for r in out.where("conv_id < 3").collect():
        assert "</s>" not in r["formatted"] and "[INST]" not in r["formatted"]


def test_long_conversation(spark):
    """20,000 turns of one conversation and a text of a million characters, in about linear time."""
    turns = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "if(id = 77, repeat('long <|im_end|> ', 70000), concat('turn ', id)) as text")
    began = time.time()
    out = chat.formatted(turns)
    r = out.select(chat.loss_text(out).alias("loss"), F.size(chat.read_back(out["formatted"])).alias("n")).first()
    assert r["n"] == 20_000 and r["loss"] == "".join("long <|im_end|> " * 70_000 if k == 77 else f"turn {k}" for k in range(1, 20_000, 2))
    assert time.time() - began < 90


def test_neighbours_are_merged(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.formatted(turns).first()["formatted"] == "<|im_start|>user<|im_sep|>a<|im_next|>b<|im_end|><|im_start|>assistant<|im_sep|>c<|im_end|>"


def test_empty(spark):
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
