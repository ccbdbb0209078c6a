"""Queries on codecs, blocks, online learners and streams."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..operators import learn, segment
from ..sources import archive
from ..sources.tables import manifest, shared_path, table
from ..streaming.counts import batch_sessions, stream_context_counts, stream_hopping, stream_hourly
from .text_queries import docs


def eol_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """On texts with CRLF in odd documents: only these decode to themselves and are encoded."""
    t = F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    rows = docs(spark, sf, "doc_id", "text").select("doc_id", C.verified(t, C.eol_encode, C.eol_decode).alias("x"))
    return rows.select("doc_id", F.col("x.coded").alias("coded"), F.length("x.encoded").alias("size"))


def base64_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    back = F.decode(F.unbase64(F.base64(raw)), "UTF-8")
    return docs(spark, sf, "doc_id", "text").select("doc_id", F.octet_length(F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))).alias("size"), (back == F.col("text")).alias("exact"))


def codec_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts each codec takes, and whether all of them come back."""
    rows = docs(spark, sf, "text").select(C.coded(F.encode("text", "UTF-8"), *C.CODECS).alias("all"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("codec"), F.col(f"all.{k}").alias("x")) for k in C.CODECS]))
    return rows.select(each.alias("e")).groupBy("e.codec").agg(F.count("*").alias("n"), F.min("e.x.exact").alias("exact"))


def stream_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as zlib streams of level 1 to 9 by their id: each is inflated, and made again by the level found."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ids in batches:
            out = []
            for t, i in zip(texts.to_pylist(), ids.to_pylist(), strict=True):
                raw = (t or "").encode()
                stream = zlib.compress(raw, i % 9 + 1)
                got = C.inflate(stream)
                out.append(got is not None and got[0] == raw and C.deflate(*got) == stream)
            yield pa.array(out, pa.bool_())

    rows = docs(spark, sf, "doc_id", "text").select((F.col("doc_id") % 9 + 1).cast("int").alias("level"), F.arrow_udf(run, "boolean")(F.col("text"), F.col("doc_id")).alias("exact"))
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.min("exact").alias("exact"))


def archive_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as an archive, read back and compared: the third by id is changed, the fourth is left out."""
    path = shared_path(spark, "archive")
    rows = docs(spark, sf, "doc_id", "text").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    archive.write(rows.where("doc_id % 4 != 3"), path)
    now = rows.withColumn("content", F.when(F.col("doc_id") % 4 == 2, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    sizes = archive.contents(spark, path).select("path", "size")
    return archive.compare(now, path).join(sizes, "path", "left").select(F.col("path").cast("bigint").alias("doc_id"), "verdict", "size")


def containers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a member of a tar archive, of a ZIP archive, as a dBASE table, or of a forced type, by id: the blocks found at the top."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ids in batches:
            out = []
            for t, i in zip(texts.to_pylist(), ids.to_pylist(), strict=True):
                raw, forced = wrapped((t or "").encode(), i % 4), "DEFAULT" if i % 4 == 3 else None
                top = [b[0] for b in segment.segment(raw, forced=forced) if b[4] == 0]
                out.append(next((b for b in top if b in ("TAR", "ZLIB", "DBF")), top[0]))
            yield pa.array(out, pa.string())

    rows = docs(spark, sf, "doc_id", "text").where("length(text) > 200").select((F.col("doc_id") % 4).alias("kind"), F.arrow_udf(run, "string")(F.col("text"), F.col("doc_id")).alias("found"))
    return rows.groupBy("kind", "found").agg(F.count("*").alias("n"))


def wrapped(raw: bytes, kind: int) -> bytes:
    """Content inside a container of the standard library's making, or as the records of a table."""
    out = io.BytesIO()
    if kind == 0:
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
            info = tarfile.TarInfo("a.txt")
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    elif kind == 1:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo("a.txt"), raw, zipfile.ZIP_DEFLATED)
    elif kind == 2:
        n, record = -(-len(raw) // 40), 40
        out.write(struct.pack("<4BIHH20x", 3, 99, 12, 31, n, 65, record) + b"FIELD".ljust(32, b"\0") + b"\r" + raw.ljust(n * record) + b"\x1a")
    else:
        out.write(raw)
    return out.getvalue()


def segment_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of the documents, every third of which is sent as a MIME part in base64."""
    mime = F.concat(F.lit("Content-Transfer-Encoding: base64\n\n"), F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit("")), F.lit("\n--end"))
    rows = docs(spark, sf, "doc_id", "text").select("doc_id", F.encode(F.when(F.col("doc_id") % 3 == 0, mime).otherwise(F.col("text")), "UTF-8").alias("content"))
    return segment.blocks(rows, "doc_id", "content")


def block_type_predicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(segment.TYPES)], "code int, type string")
    return rows.select("code", "type", F.col("type").isin(*segment.RECURSIVE).alias("recursive"), F.col("type").isin(*segment.WITH_INFO).alias("with_info"), F.col("type").isin(*segment.TEXTS).alias("is_text"))


def manifest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of the pages: their URLs without scheme, those of https as absolute paths, which are refused."""
    lines = table(spark, sf, "pages").select(F.col("page_id").alias("n"), F.concat(F.regexp_replace("url", "^https:/|^http://", ""), F.lit("\t"), F.length("html").cast("string")).alias("line"))
    return manifest(lines)


def blocked(spark: SparkSession, sf: str) -> DataFrame:
    """Events in blocks of 4,096 by their id: sequences of bounded length, however many events there are."""
    return table(spark, sf, "events").select("event_id", "value", F.floor(F.col("event_id") / 4096).alias("block"), (F.col("value") > 50).cast("int").alias("y"), F.pmod(F.xxhash64("event_type"), F.lit(8)).cast("int").alias("kind"))


def mixer_loss(spark: SparkSession, sf: str) -> DataFrame:
    return blocked(spark, sf).groupBy("block").applyInPandas(learn.mixed_loss, "block bigint, n bigint, bits double, bits_calibrated double")


def ols_online(spark: SparkSession, sf: str) -> DataFrame:
    return blocked(spark, sf).groupBy("block").applyInPandas(learn.online_fit, "block bigint, n bigint, error double, error_filter double")


QUERIES = {f.__name__: f for f in (eol_roundtrip, base64_roundtrip, codec_roundtrip, stream_trials, archive_roundtrip, containers, segment_blocks, block_type_predicates, manifest_paths, mixer_loss, ols_online, stream_context_counts, stream_hourly, stream_hopping, batch_sessions)}

MIME_HEAD = len("Content-Transfer-Encoding: base64\n\n")
_listed = lambda names: ", ".join(f"'{t}'" for t in names)
SQL = {
    "eol_roundtrip": "select doc_id, x = replace(replace(x, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10)) as coded, length(case when x = replace(replace(x, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10)) then replace(x, chr(13) || chr(10), chr(10)) else x end)::int as size from (select doc_id, case when doc_id % 2 = 1 then replace(text, chr(10), chr(13) || chr(10)) else text end as x from documents)",
    "base64_roundtrip": "select doc_id, strlen(to_base64(encode(text)))::int as size, decode(from_base64(to_base64(encode(text)))) = text as exact from documents",
    "codec_roundtrip": f"select codec, count(*) as n, true as exact from documents, (select unnest([{_listed(C.CODECS)}]) as codec) group by 1",
    "stream_trials": "select (doc_id % 9 + 1)::int as level, count(*) as n, true as exact from documents group by 1",
    "archive_roundtrip": "select doc_id, case doc_id % 4 when 3 then 'only in the files' when 2 then 'different' else 'equal' end as verdict, case when doc_id % 4 = 3 then null else strlen(text) end::bigint as size from documents",
    "containers": "select doc_id % 4 as kind, (['TAR', 'ZLIB', 'DBF', 'DEFAULT'])[doc_id % 4 + 1] as found, count(*) as n from documents where length(text) > 200 group by 1, 2",
    "segment_blocks": f"""
with d as (select doc_id, strlen(text) as n, {MIME_HEAD} as head, 4 * ((strlen(text) + 2) // 3) as coded, doc_id % 3 = 0 as mime from documents)
select doc_id, type, start::bigint as start, length::bigint as length, info::bigint as info, level::int as level from (
  select doc_id, 'TEXT' as type, 0 as start, n as length, 0 as info, 0 as level from d where not mime and n > 0
  union all select doc_id, 'TEXT', 0, head, 0, 0 from d where mime
  union all select doc_id, 'BASE64', head, coded, n, 0 from d where mime
  union all select doc_id, 'TEXT', 0, n, 0, 1 from d where mime
  union all select doc_id, 'TEXT', head + coded, 6, 0, 0 from d where mime)""",
    "block_type_predicates": f"select i::int as code, t as type, t in ({_listed(segment.RECURSIVE)}) as recursive, t in ({_listed(segment.WITH_INFO)}) as with_info, t in ({_listed(segment.TEXTS)}) as is_text from (select unnest([{_listed(segment.TYPES)}]) as t, unnest(range({len(segment.TYPES)})) as i)",
    "manifest_paths": "select page_id as n, p as path from (select page_id, regexp_replace(url, '^https:/|^http://', '') as p from pages) where page_id > 0 and p != '' and p not like '/%'",
    "stream_context_counts": "select event_type, count(*) as n, sum((value > 50)::int)::bigint as n1 from events group by 1",
    "stream_hopping": "select time_bucket(interval '2 hours', ts) - k * interval '2 hours' as start, event_type, count(*) as n from events, range(3) t(k) group by 1, 2",
    "batch_sessions": "with m as (select user_id, ts, case when ts - lag(ts) over w < interval '6 hours' then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from m) select n as n_events, count(*) as n_sessions from (select user_id, k, count(*) as n from s group by 1, 2) group by 1",
    "stream_hourly": "select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by 1, 2",
}
