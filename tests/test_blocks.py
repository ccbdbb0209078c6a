import base64
import io
import tarfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamspark.functions import codecs as C
from loamspark.operators import learn, segment


@pytest.mark.parametrize("name", sorted(C.CODECS))
@settings(max_examples=60, deadline=None)
@given(raw=st.binary(max_size=2000))
def test_codecs_are_reversible(name, raw):
    encode, decode = C.CODECS[name]
    assert decode(encode(raw)) == raw
    assert decode(encode(b"z" * 1000)) == b"z" * 1000


@pytest.mark.parametrize("level", range(1, 10))
@pytest.mark.parametrize("memory", (1, 5, 9))
def test_streams_are_made_again(level, memory):
    raw = b"some text and some more " * 300 + bytes(range(256)) * 3
    for bits in (15, 10, -15):
        c = zlib.compressobj(level, zlib.DEFLATED, bits, memory)
        stream = c.compress(raw) + c.flush()
        got = C.inflate(stream, bits if bits < 0 else None)
        assert got[0] == raw and not got[3]
        assert C.deflate(*got, bits) == stream


def test_streams_that_differ_a_little():
    raw = b"some text " * 300
    stream = bytearray(zlib.compress(raw, 9))
    stream[1] ^= 0  # the header as it is; a changed checksum would not inflate
    assert C.inflate(bytes(stream))[0] == raw
    assert C.inflate(b"no stream") is None and C.inflate(bytes(stream[:-3])) is None and C.inflate(b"") is None


def test_bombs_do_not_inflate(monkeypatch):
    monkeypatch.setattr(C, "INFLATED", 1 << 20)
    bomb = zlib.compress(bytes(1 << 24), 9)
    assert C.inflated(bomb) is None
    assert [b[0] for b in segment.segment(b"\xff" * 40 + bomb)] == ["DEFAULT"]


@settings(max_examples=60, deadline=None)
@given(raw=st.binary(max_size=1500), kinds=st.lists(st.integers(0, 4), max_size=40))
def test_predictors_are_reversible(raw, kinds):
    rows = bytearray(raw)
    for k in range(len(raw) // 49):
        rows[k * 49] = kinds[k % len(kinds)] if kinds else 0
    assert C.predictors_decode(C.predictors_encode(bytes(rows))) == bytes(rows)


def test_predictors_undo_gradients():
    """A slope in both directions is constant under each predictor but the first."""
    x = (np.arange(16)[None, :, None] * 2 + np.arange(8)[:, None, None] * 3 + np.zeros(3, int)).astype(np.uint8)
    pixels = x.reshape(8, 48)
    for kind in range(5):
        filtered = C.predictors_decode(bytes([kind] * 8) + pixels.tobytes())
        assert C.predictors_encode(filtered) == bytes([kind] * 8) + pixels.tobytes()
    assert C.paeth(np.uint8(10), np.uint8(20), np.uint8(10)) == 20 and C.paeth(np.uint8(7), np.uint8(7), np.uint8(7)) == 7


def test_runs_and_colours_have_their_format():
    assert C.runs_encode(b"a" * 5 + b"bc") == bytes((0x84,)) + b"a" + b"\x01bc"
    assert C.runs_encode(b"x" * 200) == bytes((0xFF,)) + b"x" + bytes((0xC7,)) + b"x"
    assert C.colours_encode(bytes((1, 2, 5)) * 16)[:3] == bytes((2, 253, 1))


def test_first_matches_that_do_not_decode_hide_nothing():
    good = b"plain words, nothing else. " * 4
    bad = b";base64," + b"A" * 33 + b"!!"
    found = [b[0] for b in segment.segment(bad + b" and ;base64," + base64.b64encode(good) + b" end") if b[4] == 0]
    assert "BASE64" in found


def test_containers():
    from loamspark.plans.block_queries import wrapped

    text = b"plain words, nothing else. " * 20
    assert [(b[0], b[4]) for b in segment.segment(wrapped(text, 1))][1:3] == [("ZLIB", 0), ("TEXT", 1)]
    table = segment.segment(wrapped(text, 2))
    assert table == [("DBF", 0, len(wrapped(text, 2)), 40, 0)]
    assert segment.segment(text, forced="DEFAULT") == [("DEFAULT", 0, len(text), 0, 0)]
    tar = wrapped(text, 0)
    assert C.tar_decode(C.tar_encode(tar)) == tar and C.tar_encode(tar) != tar


def test_archive_header(spark, tmp_path):
    from loamspark.sources import archive

    files = spark.createDataFrame([("a", b"x" * 100), ("b", None), ("c", bytes(range(256)))], "path string, content binary")
    archive.write(files, f"file://{tmp_path}/one")
    assert {r["path"]: bytes(r["content"]) for r in archive.extract(spark, f"file://{tmp_path}/one").collect()} == {"a": b"x" * 100, "b": b"", "c": bytes(range(256))}
    assert {r["verdict"] for r in archive.compare(files, f"file://{tmp_path}/one").collect()} == {"equal"}
    with pytest.raises(Exception, match="(?i)exist"):
        archive.write(files, f"file://{tmp_path}/one")
    spark.createDataFrame([("zip", 1, 6)], "magic string, version int, level int").write.parquet(f"{tmp_path}/two/header")
    with pytest.raises(ValueError, match="no archive"):
        archive.contents(spark, f"file://{tmp_path}/two")


def test_segments():
    text = b"plain words, nothing else. " * 20
    packed = zlib.compress(text, 9)
    assert segment.segment(b"") == []
    assert segment.segment(text) == [("TEXT", 0, len(text), 0, 0)]
    assert segment.segment(text.replace(b". ", b".\r\n"))[0][0] == "TEXT_EOL"
    kinds = [(b[0], b[4]) for b in segment.segment(b"\xff\x00" * 50 + packed + text)]
    assert kinds == [("DEFAULT", 0), ("ZLIB", 0), ("TEXT", 1), ("TEXT", 0)]
    mime = b"Content-Transfer-Encoding: base64\n\n" + base64.b64encode(packed) + b"\n--end"
    assert [(b[0], b[4]) for b in segment.segment(mime)] == [("TEXT", 0), ("BASE64", 0), ("ZLIB", 1), ("TEXT", 2), ("TEXT", 0)]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        info = tarfile.TarInfo("a.txt")
        info.size = len(text)
        t.addfile(info, io.BytesIO(text))
    assert [b[0] for b in segment.segment(out.getvalue())] == ["TAR", "TEXT"]


def test_blocks_cover_their_level():
    raw = b"head " * 10 + b"<~" + base64.a85encode(b"inner text " * 20) + b"~> tail"
    top = [b for b in segment.segment(raw) if b[4] == 0]
    assert [b[1] for b in top] == [0, *np.cumsum([b[2] for b in top])[:-1]] and sum(b[2] for b in top) == len(raw)


def test_least_squares_learns_a_line():
    x = np.stack((np.ones(400), np.arange(400) / 400), axis=1)
    y = x @ np.array([3.0, -2.0])
    assert np.abs(learn.least_squares(x, y) - y)[-50:].max() < 0.05


def test_mixer_beats_its_worst_input():
    rng = np.random.default_rng(1)
    y = (rng.random(2000) < 0.8).astype(float)
    p = np.stack((np.full(2000, 0.8), np.full(2000, 0.3)), axis=1)
    q = learn.mix(p, y)
    loss = lambda v: -np.log2(np.where(y == 1, v, 1 - v)).mean()
    assert loss(q) < loss(p[:, 1]) and loss(q) < 1.0


def test_weight_sets_learn_by_context():
    """One input is right in one context and wrong in the other: a set of weights for each context tells them apart."""
    rng = np.random.default_rng(2)
    c = rng.integers(0, 2, 4000)
    y = (rng.random(4000) < 0.5).astype(float)
    p = np.where((y == 1) == (c == 0), 0.8, 0.2)[:, None].repeat(2, axis=1)
    loss = lambda q: -np.log2(np.where(y == 1, q, 1 - q))[2000:].mean()
    assert loss(learn.mix(p, y, contexts=c)) < 0.4 < 0.9 < loss(learn.mix(p, y))


def test_calibration_moves_towards_the_truth():
    rng = np.random.default_rng(4)
    y = (rng.random(6000) < 0.7).astype(float)
    stages = [learn.Calibration(), learn.Calibration()]
    q = np.array([learn.chain(0.4, stages, (0, 0), v) for v in y])
    assert q[0] == pytest.approx(0.4, abs=0.01) and abs(q[-500:].mean() - 0.7) < 0.15
    flat = learn.Calibration()
    assert all(abs(flat.step(p, 0, p) - p) < 0.02 for p in (0.02, 0.3, 0.5, 0.9))


def test_least_squares_forms_agree():
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(300, 4)), rng.normal(size=4)
    y = x @ w + rng.normal(size=300) * 0.01
    # with the ridge forgotten alike, both forms are the same regression
    assert np.allclose(learn.least_squares(x, y, 1.0), learn.batch_least_squares(x, y, 1.0), atol=1e-6)
    assert np.abs(learn.batch_least_squares(x, y, every=8) - y)[100:].max() < 0.2


def test_filters_follow_a_wave():
    v = np.sin(np.arange(3000) / 7) * 10
    filtered = learn.normalised_filter(learn.taps(v, 16), v)
    assert np.abs(filtered - v)[-300:].mean() < 1.5
    fitted = learn.linear_predictions(v[:600], 32)
    assert fitted.shape == (600, 3) and np.abs(fitted - v[:600, None])[-100:].max() < 0.1
    assert learn.taps(np.arange(1.0, 5), 2, 2).tolist() == [[0, 0], [0, 0], [1, 0], [2, 0]]
