"""Reversible codecs with verification: what does not decode to itself stays as it was."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def verified(value: Column, encode: Callable[[Column], Column], decode: Callable[[Column], Column]) -> Column:
    """struct(encoded, coded): the encoded value if it decodes to the original, else the original."""
    return F.when(decode(encode(value)) == value, F.struct(encode(value).alias("encoded"), F.lit(True).alias("coded"))).otherwise(F.struct(value.alias("encoded"), F.lit(False).alias("coded")))


def eol_encode(text: Column) -> Column:
    """CRLF becomes LF; a lone CR stays."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def eol_decode(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\r\n"))


def swap_pairs(raw: bytes) -> bytes:
    """Byte pairs swapped; an odd last byte stays. Its own inverse."""
    even = len(raw) & ~1
    return np.frombuffer(raw[:even], np.uint8).reshape(-1, 2)[:, ::-1].tobytes() + raw[even:]


def runs_encode(raw: bytes) -> bytes:
    """Packets as in run-length coded images: 128 + n - 1 and a byte for n equal ones, n - 1 and n bytes for others; n is 128 at most."""
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return b""
    start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    size = np.diff(np.append(start, len(a)))
    out, plain = bytearray(), bytearray()

    def flush() -> None:
        for k in range(0, len(plain), 128):
            out.append(len(plain[k : k + 128]) - 1)
            out.extend(plain[k : k + 128])
        plain.clear()

    for at, n in zip(start.tolist(), size.tolist(), strict=True):
        if n < 3:
            plain.extend(raw[at : at + n])
            continue
        flush()
        for k in range(0, n, 128):
            out += bytes((127 + min(128, n - k), raw[at]))
    flush()
    return bytes(out)


def runs_decode(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = (raw[at] & 127) + 1
        if raw[at] & 128:
            out += raw[at + 1 : at + 2] * n
            at += 2
        else:
            out += raw[at + 1 : at + 1 + n]
            at += 1 + n
    return bytes(out)


def colours_encode(raw: bytes, width: int = 48, stride: int = 3) -> bytes:
    """Pixels of blue, green, red (and alpha), rows of width bytes, as green, green - red, green - blue (alpha); what is no pixel stays."""
    return _pixels(raw, width, stride, lambda p: (p[..., 1], p[..., 1] - p[..., 2], p[..., 1] - p[..., 0]))


def colours_decode(raw: bytes, width: int = 48, stride: int = 3) -> bytes:
    return _pixels(raw, width, stride, lambda p: (p[..., 0] - p[..., 2], p[..., 0], p[..., 0] - p[..., 1]))


def _pixels(raw: bytes, width: int, stride: int, turn: Callable[[np.ndarray], tuple]) -> bytes:
    rows, used = len(raw) // width, width // stride * stride
    out = np.frombuffer(raw, np.uint8).copy()
    pixels = out[: rows * width].reshape(rows, width)[:, :used].reshape(rows, used // stride, stride)
    pixels[..., :3] = np.stack(turn(pixels.copy()), axis=-1)
    out[: rows * width].reshape(rows, width)[:, :used] = pixels.reshape(rows, used)
    return out.tobytes()


def paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of three neighbours that nearest to left + up - corner; ties go to the left, then the upper one."""
    left, up, corner = (np.asarray(x, np.int16) for x in (left, up, corner))
    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner)).astype(np.uint8)


def _predicted(kind: int, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    if kind == 3:
        return ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    return (np.zeros_like(left), left, up, left, paeth(left, up, corner))[kind]


def predictors_encode(raw: bytes, width: int = 48, stride: int = 3) -> bytes:
    """Rows of a predictor's number (0 to 4) and width residuals: the numbers of all rows, then the pixels; what is no whole row stays last."""
    rows = len(raw) // (width + 1)
    a = np.frombuffer(raw, np.uint8)[: rows * (width + 1)].reshape(rows, width + 1)
    if rows and a[:, 0].max() > 4:
        raise ValueError("no such predictor")
    columns = width // stride
    if columns * stride != width:
        raise ValueError("rows of whole pixels only")
    residual, pixels = a[:, 1:].reshape(rows, columns, stride), np.zeros((rows + 1, columns + 1, stride), np.uint8)
    for r in range(rows):
        up, kind = pixels[r], int(a[r, 0])
        if kind in (0, 2):
            pixels[r + 1, 1:] = residual[r] + (up[1:] if kind else 0)
        elif kind == 1:
            pixels[r + 1, 1:] = np.cumsum(residual[r], axis=0, dtype=np.uint8)
        else:
            for c in range(columns):
                pixels[r + 1, c + 1] = residual[r, c] + _predicted(kind, pixels[r + 1, c], up[c + 1], up[c])
    return a[:, 0].tobytes() + pixels[1:, 1:].tobytes() + raw[rows * (width + 1) :]


def predictors_decode(raw: bytes, width: int = 48, stride: int = 3) -> bytes:
    rows = len(raw) // (width + 1)
    kinds, columns = np.frombuffer(raw, np.uint8)[:rows], width // stride
    pixels = np.zeros((rows + 1, columns + 1, stride), np.uint8)
    pixels[1:, 1:] = np.frombuffer(raw, np.uint8)[rows : rows * (width + 1)].reshape(rows, columns, stride)
    out = np.empty((rows, width + 1), np.uint8)
    out[:, 0] = kinds
    for k in range(5):
        at = np.flatnonzero(kinds == k)
        want = _predicted(k, pixels[at + 1, :-1], pixels[at, 1:], pixels[at, :-1])
        out[at, 1:] = (pixels[at + 1, 1:] - want).reshape(len(at), width)
    return out.tobytes() + raw[rows * (width + 1) :]


def tar_members(raw: bytes) -> list[tuple[int, int, int]]:
    """Of a USTAR archive with right checksums: each member's header, content and length; nothing of other contents."""
    at, out = 0, []
    while at + 512 <= len(raw) and raw[at] and raw[at + 257 : at + 262] == b"ustar":
        head = raw[at : at + 512]
        digits, size = head[148:156].strip(b" \0"), head[124:136].strip(b" \0") or b"0"
        if not digits.isdigit() or not size.isdigit() or tar_sum(head) != int(digits, 8):
            return []
        out.append((at, at + 512, int(size, 8)))
        at += 512 + -(-int(size, 8) // 512) * 512
    return out


def tar_sum(head: bytes) -> int:
    return sum(head[:148]) + 8 * 32 + sum(head[156:])


def tar_encode(raw: bytes) -> bytes:
    """The checksums of the headers, where they are spelled as usual, as zeros: they follow from the rest."""
    out = bytearray(raw)
    for at, _, _ in tar_members(raw):
        if raw[at + 148 : at + 156] == b"%06o\0 " % tar_sum(raw[at : at + 512]):
            out[at + 148 : at + 156] = bytes(8)
    return bytes(out)


def tar_decode(raw: bytes) -> bytes:
    out, at = bytearray(raw), 0
    while at + 512 <= len(out) and out[at] and out[at + 257 : at + 262] == b"ustar":
        if out[at + 148 : at + 156] == bytes(8):
            out[at + 148 : at + 156] = b"%06o\0 " % tar_sum(bytes(out[at : at + 512]))
        at += 512 + -(-int(out[at + 124 : at + 136].strip(b" \0") or b"0", 8) // 512) * 512
    return bytes(out)


#: Bytes that a stream may inflate to, and differences that a remade stream may have.
INFLATED, DIFFERENT = 1 << 28, 128


def inflated(raw: bytes | memoryview, bits: int = 15) -> tuple[bytes, int] | None:
    """What a stream at the start of raw inflates to and how long it is; None if it is none, is cut, or would inflate beyond INFLATED."""
    d, parts, total, rest = zlib.decompressobj(bits), [], 0, raw
    try:
        while not d.eof:
            part = d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
            total += len(part)
            if total > INFLATED or (not part and not rest and not d.eof):
                return None
            parts.append(part)
    except zlib.error:
        return None
    return b"".join(parts), len(raw) - len(d.unused_data) - len(rest)


def inflate(stream: bytes, bits: int | None = None) -> tuple[bytes, int, int, list[tuple[int, int]]] | None:
    """The payload of a stream, with the level and memory level of the 81 that make it again and the bytes (place, value) in which that differs.

    The trials that the header's own level names come first; the first without a difference is taken, else that of least, up to DIFFERENT.
    """
    bits = bits or ((stream[0] >> 4) + 8 if stream and stream[0] & 15 == 8 else 15)
    got = inflated(stream, bits if bits < 0 else 15)
    if got is None or got[1] != len(stream):
        return None
    named = {0: (1,), 1: (2, 3, 4, 5), 2: (6,), 3: (7, 8, 9)}[stream[1] >> 6] if bits > 0 and len(stream) > 1 else ()
    best = None
    for level in sorted(range(1, 10), key=lambda k: (k not in named, k)):
        for memory in (8, 9, *range(1, 8)):
            c = zlib.compressobj(level, zlib.DEFLATED, bits, memory)
            made = c.compress(got[0]) + c.flush()
            if made == stream:
                return got[0], level, memory, []
            if len(made) == len(stream):
                other = np.flatnonzero(np.frombuffer(made, np.uint8) != np.frombuffer(stream, np.uint8))
                if len(other) <= DIFFERENT and (best is None or len(other) < len(best[3])):
                    best = got[0], level, memory, [(int(k), stream[k]) for k in other]
    return best


def deflate(raw: bytes, level: int, memory: int, differences: list[tuple[int, int]], bits: int = 15) -> bytes:
    """The stream that inflate() has read."""
    c = zlib.compressobj(level, zlib.DEFLATED, bits, memory)
    out = bytearray(c.compress(raw) + c.flush())
    for at, value in differences:
        out[at] = value
    return bytes(out)


CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "base85": (base64.a85encode, base64.a85decode),
    "zlib": (lambda b: zlib.compress(b, 6), zlib.decompress),
    "pairs": (swap_pairs, swap_pairs),
    "runs": (runs_encode, runs_decode),
    "colours": (colours_encode, colours_decode),
    "tar": (tar_encode, tar_decode),
}


def coded(content: Column, *names: str) -> Column:
    """By codec, struct(size, exact): bytes after encoding, and whether decoding gives the content back. One worker runs all codecs of a task."""
    kind = pa.struct([("size", pa.int64()), ("exact", pa.bool_())])

    def one(v: bytes | None, name: str) -> dict | None:
        if v is None:
            return None
        encode, decode = CODECS[name]
        out = encode(v)
        return {"size": len(out), "exact": decode(out) == v}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            rows = [{k: one(v, k) for k in names} for v in (x.as_py() for x in values)]
            yield pa.array(rows, pa.struct([(k, kind) for k in names]))

    return F.arrow_udf(run, f"struct<{','.join(f'`{k}`:struct<size:bigint,exact:boolean>' for k in names)}>")(content)
