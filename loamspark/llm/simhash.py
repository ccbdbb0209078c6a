"""SimHash near-dedup: pivot distance tables.

Fingerprints: 3-word shingles (the contract's own length), XXH64, majority bits. Two
fingerprints link at 2 or fewer differing bits. Links are found among distinct fingerprints:

1. Pivot tables hold the Hamming distances to PIVOTS reference fingerprints, for each of four 16-bit blocks.
   Of four blocks two at least are alike in a linked pair, and so is their row of pivot distances:
   (two blocks' pivot distances) is an equi-join key that loses no link.
2. In a bucket of such a key, pairs whose distances to any pivot differ by more than 2
   are discarded (triangle inequality), and survivors are verified bit by bit.
3. A bucket of more than BUCKET fingerprints is not paired at all. Its members are tied to each of the 65 words
   within one bit of them; fingerprints at 2 or fewer bits meet in such a word, so stars of
   (fingerprint, word) have the same components, in rows linear in the members.

Components come from star contraction in the shared folder; nothing is gathered on the driver.

Defined cases: null text and text without words have fingerprint zero, linked like any other;
fewer than three words are one shingle; repeated rows and equal fingerprints are one node;
component_id is the smallest doc_id, nulls aside; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, bounded_batches, components, forget, run_id, scratch, shielded, sized, stored, table

SHINGLE, SEED, BITS, MOST = 3, 42, 64, 2
PIVOTS, BLOCKS, BUCKET = 12, 4, 32


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    lo, hi = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(lo, hi, strict=True)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; of none zero."""
    n, set_in = len(hashes), np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8)
        bits = np.unpackbits(part, bitorder="little")
        rows = np.zeros((-(-len(bits) // (BITS * 64)), 64 * BITS), np.uint8)  # sums of 64 rows fit a byte
        rows.reshape(-1)[: len(bits)] = bits
        for half in (32, 16, 8, 4, 2, 1):
            rows = rows[:, : half * BITS] + rows[:, half * BITS :]
        set_in += rows.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([np.uint64(fingerprint(t.as_py())).astype(np.int64) for t in texts], pa.int64())


def fingerprints(text: Column) -> Column:
    """The fingerprint of a text as a long with the same 64 bits."""
    return F.arrow_udf(_fingerprints, "long")(text)


def pivots(n: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints (splitmix64), as signed longs."""
    out, x = [], 0x5EED
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) % 2**64
        z ^= z >> 31
        out.append(z - 2**64 if z >= 2**63 else z)
    return out


def pivot_tables(nodes: DataFrame, *also: str) -> DataFrame:
    """fp, columns of nodes, table_0 .. table_3 (a block's pivot distances, 5 bits each) and reach (the whole distances)."""
    width = BITS // BLOCKS
    near = lambda p, b: F.expr(f"bit_count((fp ^ {p}L) & shiftleft({2**width - 1}L, {b * width}))").cast("long")
    packed = []
    for b in range(BLOCKS):
        col = F.lit(0).cast("long")
        for k, p in enumerate(pivots()):
            col = col + F.shiftleft(near(p, b), 5 * k)
        packed.append(col.alias(f"table_{b}"))
    reach = F.array(*[F.expr(f"cast(bit_count(fp ^ {p}L) as tinyint)") for p in pivots()])
    return nodes.select("fp", *also, *packed, reach.alias("reach"))


def candidate_keys(nodes: DataFrame, *also: str) -> DataFrame:
    """A row for each fingerprint and pair of blocks: key, fp, reach. Keys are hashes; a clash only adds a pair to verify."""
    pairs = [(a, b) for a in range(BLOCKS) for b in range(a + 1, BLOCKS)]
    keys = F.array(*[F.xxhash64(F.lit(i), f"table_{a}", f"table_{b}") for i, (a, b) in enumerate(pairs)])
    return pivot_tables(nodes, *also).select(F.explode(keys).alias("key"), "fp", *also, "reach")


def reachable(x: Column, y: Column) -> Column:
    """Whether no pivot's distances x and y differ by more than MOST: fingerprints that link always do so (triangle inequality)."""
    return F.forall(F.zip_with(x, y, lambda a, b: F.abs(a.cast("int") - b.cast("int"))), lambda d: d <= MOST)


def pivot_buckets(nodes: DataFrame) -> DataFrame:
    """key, fp, reach, count: the keys that fingerprints share."""
    keys = candidate_keys(nodes)
    return stored(keys.join(keys.groupBy("key").count().where("count > 1"), "key"), "pivot-buckets")


def links(shared: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints, or between them and a word within one bit. Same components as all links."""
    small = shared.where(f"count <= {BUCKET}").groupBy("key").agg(F.collect_list(F.struct("fp", "reach")).alias("all"))

    def partners(x: Column) -> Column:
        def fits(y: Column) -> Column:
            return (y["fp"] > x["fp"]) & reachable(x["reach"], y["reach"]) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= MOST)

        return F.transform(F.filter("all", fits), lambda y: F.struct(x["fp"].alias("u"), y["fp"].alias("v")))

    paired = small.select(F.explode(F.flatten(F.transform("all", partners))).alias("e")).select("e.u", "e.v")
    large = shared.where(f"count > {BUCKET}").select("fp").distinct()
    words = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    stars = large.select("fp", F.explode(words).alias("word"))
    hubs = stars.groupBy("word").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high")
    starred = stars.join(hubs, "word").where("fp != low").select(F.col("low").alias("u"), F.col("fp").alias("v"))
    return paired.unionByName(starred)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, fp (long), component_id, and rows that are in its component."""
    bounded_batches(docs.sparkSession)
    prints = docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp"), run_id().alias("run"))
    prints = stored(prints, "fingerprints")
    runs = prints.groupBy("fp", "run").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    nodes = stored(runs.groupBy("fp").agg(F.min("low").alias("low"), F.sum("rows").alias("rows")), "nodes")
    buckets = pivot_buckets(nodes)
    ends = components(links(buckets))
    tops = ends.select(F.col("u").alias("fp"), F.col("v").alias("top"))
    placed = nodes.join(tops, "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    multi = placed.join(tops.select("top").distinct(), "top", "left_semi")
    sums = multi.groupBy("top").agg(F.min("low").alias("top_low"), F.sum("rows").alias("top_rows"))
    joined = placed.join(sums, "top", "left")
    groups = joined.select("fp", F.when(F.col("top_rows").isNull(), F.col("low")).otherwise(F.col("top_low")).alias("component_id"), F.coalesce("top_rows", "rows").alias("component_rows"))
    out = stored(attach(prints, groups, ["fp"]).select("doc_id", "fp", "component_id", "component_rows"), "near-groups")
    forget(prints, nodes, buckets, ends)
    return out


@shielded
def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with its own columns, with one document of each component: that of the smallest doc_id.

    Rows that share this doc_id all stay (exact dedup is another operator), and so do rows
    of a component that has no doc_id.
    """
    with scratch() as keep:
        gone = keep(stored(near_groups(docs, id_col, text_col).where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-gone"))
    return docs.join(sized(gone), F.col(id_col) == F.col("__gone"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
