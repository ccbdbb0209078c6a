"""Near-dedup of the pipeline: five-word shingles, similarity (Jaccard of the sets) of 0.8 or more.

1. A document's node is the digest of its set of shingle hashes. SimHash: the set's majority bits are its fingerprint, whose pivot
   distances by block (simhash.pivot_tables) give the first of its buckets; they lose no pair at 2 or fewer differing bits.
2. Sets of similarity 0.8 differ by more bits than pivots can select by, so BANDS keys of ROWS minima each are further buckets: two
   such sets share none with probability 5e-8, of 0.9 with 1e-15.
3. In every bucket all members are compared with one of them by their whole sets: with the one that meets most others in all its buckets,
   which in a group of copies is what they were copied from. So a group of any size costs rows linear in it. In a pivot bucket those
   are discarded whose distances to any pivot differ by more than 2 (triangle inequality). Links so far make components.
4. Pairs of two components are compared too if they share one of the rarest shingles of both (`across_pairs`, a filter that loses none),
   so a component is that of all links between documents that share a bucket with any. Whole sets alone decide what links.

Defined cases: words as in op2; fewer than five words are one shingle; null text and text without words have the empty
set, equal to itself; one document of each component stays, that of the smallest doc_id, and rows without one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded_batches, components, run_id, scratch, shielded, sized, stored
from .simhash import candidate_keys, majority, reachable

SHINGLE, SEED, BANDS, ROWS = 5, 42, 32, 4
#: Similarity as a fraction of integers, so that exactly 0.8 counts.
LEAST = (4, 5)
_MIX = np.random.default_rng(5).integers(0, 2**63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The set of shingle hashes, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + SHINGLE]), SEED) for k in range(n)), np.uint64, n))


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def band_keys(found: np.ndarray) -> list[int]:
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(found), 1 << 12):
        low = np.minimum(low, ((found[None, k : k + (1 << 12)] ^ _MIX[0]) * _MIX[1]).min(axis=1))
    return [xxhash.xxh64_intdigest(part.tobytes(), b) for b, part in enumerate(low.reshape(BANDS, ROWS))]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """Lists of longs from buffers: no Python number for each hash."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _lists([np.array([node_of(s), majority(s), *band_keys(s)], np.uint64) for t in texts for s in [shingles(t.as_py())]])


def _sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _lists([np.concatenate([np.array([node_of(s)], np.uint64), s]) for t in texts for s in [shingles(t.as_py())]])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u != v").distinct()


def _sizes_fit(a: str, b: str) -> Column:
    return LEAST[1] * F.least(a, b) >= LEAST[0] * F.greatest(a, b)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar. sets: node, n, set. Sets join only pairs whose sizes allow it."""
    sizes = sized(sets.select("node", "n"))
    for at in ("u", "v"):
        pairs = pairs.join(sizes.select(F.col("node").alias(at), F.col("n").alias(f"n_{at}")), at)
    pairs = pairs.where(_sizes_fit("n_u", "n_v"))
    for at in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("node").alias(at), F.col("set").alias(f"set_{at}")), at)
    both = F.size(F.array_intersect("set_u", "set_v"))
    return pairs.where(LEAST[1] * both >= LEAST[0] * (F.col("n_u") + F.col("n_v") - both)).select("u", "v")


def across_pairs(sets: DataFrame, tops: DataFrame) -> DataFrame:
    """(a, b): pairs of two components that can be similar. sets: node, n, set; tops: u, v as components() gives them.

    Two sets of similarity 0.8 share a shingle among the rarest n - ceil(0.8 n) + 1 of each, whatever breaks ties. What a copy has
    of its own is rarest, so copies that are too far from each other share none of these, and few pairs are left. What comes before the
    first shingle they share is in one set only, so they share no more than what is left of either: at that shingle this must do.
    """
    each = sets.select("node", "n", F.explode("set").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    rare = each.join(often, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("all"))
    size = (F.col("n") - F.ceil(F.col("n") * LEAST[0] / LEAST[1]) + 1).cast("int")
    keys = rare.select("node", "n", F.posexplode(F.slice("all", F.lit(1), size)).alias("at", "s")).where("s.often > 1").select("node", (F.col("n") - F.col("at")).alias("left"), "n", F.col("s.shingle").alias("shingle"))
    placed = keys.join(tops.select(F.col("u").alias("node"), F.col("v").alias("top")), "node", "left").withColumn("top", F.coalesce("top", "node"))
    placed = stored(placed, "near-rare")
    open_ = placed.groupBy("shingle").agg(F.min("top").alias("low"), F.max("top").alias("high")).where("low != high").select("shingle")
    rest = stored(placed.join(sized(stored(open_, "near-open")), "shingle", "left_semi"), "near-rest")
    pairs = rest.alias("l").join(rest.alias("r"), "shingle").where("l.node < r.node and l.top != r.top").where(_sizes_fit("l.n", "r.n"))
    pairs = pairs.where((LEAST[0] + LEAST[1]) * F.least("l.left", "r.left") >= LEAST[0] * (F.col("l.n") + F.col("r.n")))
    return pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """key, node, reach: the pivot buckets of each node with its fingerprint's pivot distances, and its bands without. nodes: node, fp, keys."""
    bands = nodes.select(F.explode("keys").alias("key"), "node", F.lit(None).cast("array<tinyint>").alias("reach"))
    return candidate_keys(nodes, "node").select("key", "node", "reach").unionByName(bands)


def near_tops(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, top: of each node with a similar one but the first of its component. prints: doc_id, node, fp, keys."""
    keys = bucket_keys(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-shared")
    held_in = stored(keys.join(sized(shared), "key"), "near-held-in")
    # the member that meets most others is the likeliest to be what the others were copied from; ties are broken in another way in every bucket
    central = held_in.join(held_in.groupBy("node").agg(F.sum("n").alias("met")), "node")
    hubs = central.groupBy("key").agg(F.max(F.struct("met", F.col("node").bitwiseXOR(F.col("key")), "node", "reach")).alias("h")).select("key", F.col("h.node").alias("hub"), F.col("h.reach").alias("hub_reach"))
    members = stored(held_in.select("key", "node", "reach").join(hubs, "key").select("node", "hub", F.coalesce(reachable(F.col("reach"), F.col("hub_reach")), F.lit(True)).alias("meets")), "near-members")
    held = stored(members.select("node").distinct(), "near-held")
    owners = prints.join(sized(held), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    owners = stored(owners.select(F.col("doc_id").alias("__owner")).distinct(), "near-owners")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(sized(owners), F.col("doc_id").eqNullSafe(F.col("__owner")), "left_semi")
    # called nondeterministic, or the semi join moves below and has the sets computed twice, by two Python workers a task
    found = F.arrow_udf(_sets, "array<long>").asNondeterministic()
    sets = texts.select(found(F.col("text")).alias("s")).select(F.get("s", F.lit(0)).alias("node"), F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))).alias("set"))
    sets = stored(sets.join(sized(held), "node", "left_semi").dropDuplicates(["node"]).withColumn("n", F.size("set")), "near-sets")
    stars = stored(_ordered(members.where("meets").select(F.col("hub").alias("a"), F.col("node").alias("b"))), "near-stars")
    edges = stored(similar(stars, sets), "near-edges")
    tops = components(edges)
    across = stored(_ordered(across_pairs(sets, tops)).join(stars, ["u", "v"], "left_anti"), "near-across")
    more = stored(similar(across, sets), "near-more")
    if not more.isEmpty():
        tops = components(edges.unionByName(more))
    return tops.select(F.col("u").alias("node"), F.col("v").alias("top"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: a row for each document."""
    bounded_batches(docs.sparkSession)
    found: Column = F.arrow_udf(_prints, "array<long>")(F.col(text_col))
    prints = docs.select(F.col(id_col).alias("doc_id"), found.alias("s"), run_id().alias("run"))
    prints = stored(prints.select("doc_id", "run", F.get("s", F.lit(0)).alias("node"), F.get("s", F.lit(1)).alias("fp"), F.slice("s", 3, BANDS).alias("keys")), "near-prints")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("low"))
    placed = stored(nodes.join(sized(near_tops(docs, prints, id_col, text_col)), "node", "left").withColumn("top", F.coalesce("top", "node")), "near-nodes")
    groups = placed.join(placed.groupBy("top").agg(F.min("low").alias("component_id")), "top").select("node", "component_id")
    return attach(prints.select("doc_id", "node", "run"), groups, ["node"]).select("doc_id", "component_id")


@shielded
def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with its own columns, with one document of each component: that of the smallest doc_id."""
    with scratch() as keep:
        gone = keep(stored(similar_groups(docs, id_col, text_col).where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-gone"))
    return docs.join(sized(gone), F.col(id_col) == F.col("__gone"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
