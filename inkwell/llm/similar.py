"""SimHash near-dedup at a Jaccard similarity: the generalised pigeonhole principle on wide fingerprints.

Documents are linked if the sets of their five-word shingles have a Jaccard similarity of SIMILARITY or more. At 0.8 some 15 %
of SimHash bits differ, 10 of 64, which no index of one 64-bit fingerprint can be asked for. So fingerprints here are WORDS words
of 64 bits, each from hashes of its own. Every word's bits are grouped into partitions by their correlation, as for one
fingerprint, and one dynamic program over all words gives each partition a threshold (-1: not used) for the least estimated work
that finds a pair at SIMILARITY with the chance RECALL; a pair with more alike is found more surely. Pairs that meet in a
partition are verified, first by the distance of CHECK words, then on the shingle sets themselves.

Equal sets are one. In a group that is too large for all pairs, the smallest members are compared with all others first, and
more of them round by round, until none is left or links found anywhere join the whole group: what is skipped are pairs that
are already connected, so components are those of all pairs that meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_map, packed, stash_freed, text_bytes, unpacked
from .components import components
from .simhash import BITS, _mask, _signed, allocated, ball, grouped
from .substring_dedup import mixed, rolling, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.97
WORDS = 40
#: Words on whose distance a pair is judged before its sets are read, and how many deviations above the mean may pass.
CHECK, DEVIATIONS = 4, 3
#: Partitions that a word may have, and the largest threshold of one.
PARTS, MOST = (2, 3, 4), 1
#: Costs: a filed row, one more if it meets others, a comparison.
ROW_COST, MET_COST, PAIR_COST = 1.0, 4.0, 0.05
#: Largest group of which all pairs are compared at once; each round takes GROWTH times as many members as the one before.
GROUP = 64
GROWTH = 8
_FACTORS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order; a shorter text is one shingle, one without words has none."""
    hashes = word_hashes((text or b"").lower())
    return np.unique(rolling(hashes, max(1, min(shingle, len(hashes)))))


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits: a bit is 1 if it is in over half of the shingles' hashes for that word."""
    counts = np.zeros(len(_FACTORS) * BITS, np.int64)
    for at in range(0, len(found), 255):
        hashes = mixed(np.multiply.outer(found[at : at + 255], _FACTORS))
        counts += np.add.reduce(np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def differing(similarity: float) -> float:
    """The share of SimHash bits in which sets of one size and that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, node (the hash of the set), size, sig (the fingerprint's words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):  # the texts are read already; a row adds WORDS numbers
                b = whole.slice(at, 1000)
                node, size, sig = [], [], []
                for text in text_bytes(b.column(2)):
                    found = shingles(text, shingle)
                    node.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                    size.append(len(found))
                    sig.append(wide_fingerprint(found))
                sig = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(sig).view(np.int64)), WORDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), sig], ["doc_id", "text_hash", "node", "size", "sig"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id long, text_hash long, node long, size long, sig array<long>")


def together(nodes: DataFrame) -> np.ndarray:
    """WORDS x 64 x 64 counts of fingerprints that have both bits of a word; WORDS * 4,096 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WORDS, BITS, BITS))
        for b in batches:
            words = b.column(0).flatten().to_numpy().astype("<i8").reshape(-1, WORDS)
            for k in range(WORDS):
                x = np.unpackbits(np.ascontiguousarray(words[:, k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[k] += x.T @ x
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells].astype(np.int64))], ["cell", "n"])

    out = np.zeros(WORDS * BITS * BITS)
    for cell, n in arrow_map(nodes.select("sig"), run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(WORDS, BITS, BITS)


def scheme(both: np.ndarray, n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> list[tuple[int, list[int], int]]:
    """(word, bits, threshold) of the partitions in use: the least estimated work that finds a pair at `similarity` with chance `recall`.

    A partition's chance of a match by accident is estimated from its bits' shares over all fingerprints.
    """
    p, unit, best = differing(similarity), 200, None
    for m in PARTS:
        parts, costs, gains = [], [], []
        for word in range(len(both)):
            share = np.diag(both[word]) / max(n, 1)
            for bits in grouped(both[word], n, m):
                accident = float(np.prod(share[bits] ** 2 + (1 - share[bits]) ** 2))
                cost, gain = [0.0], [0]
                for t in range(MOST + 1):
                    rows, meets = ball(len(bits), t), n * accident * ball(len(bits), t)
                    cost.append(rows * (ROW_COST + MET_COST * min(1.0, meets) + PAIR_COST * meets))
                    found = sum(math.comb(len(bits), k) * p**k * (1 - p) ** (len(bits) - k) for k in range(t + 1))
                    gain.append(round(-unit * math.log1p(-found)))
                parts.append((word, bits))
                costs.append(cost)
                gains.append(gain)
        found = allocated(costs, gains, math.ceil(-unit * math.log1p(-recall)))
        if found and (best is None or found[0] < best[0]):
            best = (found[0], [(w, bits, t) for (w, bits), t in zip(parts, found[1]) if t >= 0])
    if best is None:
        raise ValueError(f"{WORDS} words of 64 bits can't find pairs with a chance of {recall}")
    return best[1]


def filed(nodes: DataFrame, parts: list[tuple[int, list[int], int]]) -> DataFrame:
    """key, node, size, check: a row for each partition's value and those within its threshold."""
    keys = []
    for number, (word, bits, t) in enumerate(parts):
        value = F.get("sig", F.lit(word)).bitwiseAND(F.lit(_signed(_mask(bits))))
        for r in range(t + 1):
            keys += [F.xxhash64(F.lit(number), value.bitwiseXOR(F.lit(_signed(_mask(list(c)))))) for c in combinations(bits, r)]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "node", "size", *[F.get("sig", F.lit(k)).alias(f"c{k}") for k in range(CHECK)])


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, shingles of the wanted (node, th)."""
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.join(wanted, texts["text_hash"] == wanted["th"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, shingle).tobytes() for t in text_bytes(b.column(1))], pa.binary())], ["node", "shingles"])

    return arrow_map(texts, run, "node long, shingles binary").dropDuplicates(["node"])


def _share(node: Column) -> Column:
    """The place of a hash among all, 0..1."""
    return node / F.lit(2.0**64) + 0.5


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return arrow_map(pairs.join(other, "b").join(one, "a").select("a", "b", "x", "y"), run, "a long, b long")


def roots(members: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """members (key, node, size, check) -> node, root: the components of the links among members of equal key."""
    check = [f"c{k}" for k in range(CHECK)]
    share = differing(similarity)
    most = math.floor(CHECK * BITS * share + DEVIATIONS * math.sqrt(CHECK * BITS * share * (1 - share)))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in check), F.lit(0))
    by_key = Window.partitionBy("key")

    def unsettled(members: DataFrame) -> DataFrame:
        """members of groups that links don't join yet, with the group's size n and least node: by a window, so that a plan that reads it twice has one shuffle."""
        counted = {"n": F.count("*"), "low": F.min("node"), "r1": F.min("root"), "r2": F.max("root")}
        return members.withColumns({c: x.over(by_key) for c, x in counted.items()}).where("n > 1 and r1 <> r2").drop("r1", "r2")

    # The first round's are not written: that and a shuffle of what was written would take the disk of the rows thrice.
    members, edges = unsettled(members.withColumn("root", F.col("node"))), None
    while True:
        first = (F.col("n") <= group) | (F.col("node") == F.col("low")) | (_share(F.col("node")) < _share(F.col("low")) + (1 - _share(F.col("low"))) * group / F.col("n"))
        members = members.select("key", "node", "size", *check, "root", first.alias("first"))
        one = members.where("first").select("key", F.col("node").alias("a"), F.col("size").alias("m"), F.col("root").alias("r"), *[F.col(c).alias(f"_{c}") for c in check])
        near = (F.col("a") != F.col("node")) & (~F.col("first") | (F.col("a") < F.col("node"))) & (F.col("r") != F.col("root")) & (F.least("m", "size") >= similarity * F.greatest("m", "size"))
        # On the right, of which a merge join holds a key's rows in memory, are the few.
        pairs = members.join(one, "key").where(near & (apart <= most)).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        pairs = stash_freed(pairs.distinct(), "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = stash_freed(_sets(docs, nodes.select("node", "th").join(wanted, "node", "left_semi"), shingle), "sets")
        good = stash_freed(_verified(pairs, sets, similarity), "links")
        edges = good if edges is None else edges.union(good)
        known = stash_freed(components(edges), "roots")
        rest, at = members.where("not first").drop("root", "first"), known.withColumnRenamed("node", "_node")
        rest = rest.join(at, rest["node"] == at["_node"], "left").select("key", "node", "size", *check, F.coalesce("root", "node").alias("root"))
        members = stash_freed(unsettled(rest), "members")
        if members.isEmpty():
            return known
        group *= GROWTH


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """doc_id, text_hash, component_id (the smallest doc_id reachable), is_kept.

    Texts without words are one component. One row of each component, the first by doc_id (null last) and text_hash, has
    is_kept; rows alike in both are all marked. An empty table gives no rows; other columns are not read.
    """
    rows = stash_freed(signatures(docs, shingle), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = stash_freed(rows.groupBy("node").agg(first.alias("first"), F.min("text_hash").alias("th"), F.first("size").alias("size"), F.first("sig").alias("sig")), "nodes")
    parts = scheme(together(nodes), nodes.count(), similarity)
    of = roots(filed(nodes.where("size > 0"), parts), nodes, docs, similarity, shingle, group)
    known = nodes.join(of, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    known = stash_freed(known, "known")
    best = known.groupBy("root").agg(F.min("first").alias("best"))
    joined = rows.select("doc_id", "text_hash", "node").join(known.join(best, "root").select("node", "best"), "node")
    kept = joined["doc_id"].eqNullSafe(F.col("best.doc_id")) & (joined["text_hash"] == F.col("best.text_hash"))
    return joined.select("doc_id", "text_hash", F.col("best.doc_id").alias("component_id"), kept.alias("is_kept"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, with docs' columns; rows alike in doc_id and text become one."""
    keys = {"_none": F.col("doc_id").cast("long").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}  # no nulls: join and dropDuplicates share a shuffle of the texts
    kept = near_copies(docs, similarity, shingle).where("is_kept").select(*[c.alias(k) for k, c in keys.items()], F.col("text_hash").alias("_th"))
    out = packed(docs, **keys, _th=F.xxhash64("text")).join(kept, [*keys, "_th"], "left_semi")
    return unpacked(out.dropDuplicates([*keys, "_th"]), docs.columns)
